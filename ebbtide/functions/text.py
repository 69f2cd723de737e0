"""Text, date and identifier expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.numeric import col



def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form holds ASCII: those that become one character, and those that become several."""
    one, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(code)) not in ("Cs", "Cn", "Co"):
            base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if base:
                (one if len(base) == 1 else several)[chr(code)] = base
    # the Cyrillic A looks like the Latin one and is meant as such in place names
    return one | {"\u0410": "A", "\u0430": "a"}, several


_ONE, SEVERAL = _folding()
ACCENTED, UNACCENTED = "".join(_ONE), "".join(_ONE.values())


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def filled_category(value: Column | str, default: str = "Unknown") -> Column:
    return F.trim(F.coalesce(col(value).cast("string"), F.lit(default)))


def yes_no(value: Column | str) -> Column:
    """yes/no in any case or padding to 1/0, anything else null."""
    word = F.lower(F.trim(col(value).cast("string")))
    return F.when(word == "yes", F.lit(1)).when(word == "no", F.lit(0))


def zip_text(value: Column | str) -> Column:
    """Postal number as text; half-to-even rounding, missing as -1."""
    return F.bround(F.coalesce(col(value).cast("double"), F.lit(-1.0)), 0).cast("bigint").cast("string")


def postal_code(value: Column | str) -> Column:
    """First four digits in a row, a trailing ``.0`` removed before."""
    text = F.regexp_replace(F.trim(col(value).cast("string")), r"\.0$", "")
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit(""))


def after_slash(value: Column | str) -> Column:
    """What follows the first slash, or the whole text without one."""
    return blank_to_null(F.regexp_replace(col(value), r"^[^/]*/", ""))


def localised_number(value: Column | str) -> Column:
    """Spaces as thousands separator, decimal comma; empty or ``-`` is 0."""
    text = F.regexp_replace(col(value).cast("string"), "[ \\s]", "")
    return (
        F.when(text.isin("", "-"), F.lit(0.0))
        .when(text.isNotNull(), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    )


def _spellings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: where the characters it becomes begin in the third array, and how many they are; 0 for those that go."""
    folded = {ord(c): x for c, x in (_ONE | SEVERAL).items()}
    at, width = np.zeros(max(folded) + 1, np.int32), np.zeros(max(folded) + 1, np.int64)
    at[list(folded)], width[list(folded)] = np.cumsum([0, *map(len, folded.values())])[:-1], [*map(len, folded.values())]
    return at, width, _PLAIN[np.frombuffer("".join(folded.values()).encode(), np.uint8)]


#: What a byte of ASCII becomes: a lower-case letter, a digit or a space.
_PLAIN = np.array([ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)
_AT, _WIDTH, _SPELLED = _spellings()
#: Bytes of text that are folded at a time.
FOLD_BYTES = 1 << 20


def _spelled(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts as lower-case letters, digits and spaces, and where each text begins in them."""
    narrow = data < 0x80
    if narrow.all():
        return _PLAIN[data], cuts
    lead = np.flatnonzero(data >= 0xC0)
    first, (b, c, d) = data[lead].astype(np.int64), (np.append(data, [0, 0, 0])[lead + i].astype(np.int64) & 0x3F for i in (1, 2, 3))
    code = np.where(first < 0xE0, (first & 0x1F) << 6 | b, np.where(
        first < 0xF0, (first & 0xF) << 12 | b << 6 | c, (first & 7) << 18 | b << 12 | c << 6 | d))
    code[code >= len(_WIDTH)] = 0
    width = narrow.astype(np.int64)
    width[lead] = _WIDTH[code]
    place = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(place[-1], dtype=np.uint8)
    out[place[:-1][narrow]] = _PLAIN[data[narrow]]
    for i in range(int(_WIDTH[code].max(initial=0))):
        longer = _WIDTH[code] > i
        out[place[lead[longer]] + i] = _SPELLED[_AT[code[longer]] + i]
    return out, place[cuts]


def _words(column: pa.Array) -> pa.Array:
    """Texts as ASCII words joined by one space, all bytes of the column in a few steps."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[cuts[0]:cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    data, cuts = _spelled(data, cuts - cuts[0])
    word = data != 32
    keep = np.append(False, word)[:len(word)]
    keep[cuts[:-1][cuts[:-1] < len(word)]] = False
    keep |= word
    data, cuts = data[keep], np.append(0, np.cumsum(keep))[cuts]
    # a space that is kept ends its text only where no word follows
    ends = cuts[1:][cuts[1:] > cuts[:-1]] - 1
    last = ends[data[ends] == 32]
    kept = np.ones(len(data), dtype=bool)
    kept[last] = False
    cuts = (cuts - np.searchsorted(last, cuts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(column), pa.py_buffer(cuts), pa.py_buffer(data[kept]))


def _plain_names(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // FOLD_BYTES
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if len(texts) else [0]
    return pa.concat_arrays([_words(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:])] or [pa.array([], pa.string())])


def plain_name(value: Column | str) -> Column:
    """Lower-case ASCII words joined by one space; missing becomes empty.

    Accents go, and every character with a compatibility form takes it: no-break spaces part words, ligatures and full-width letters are
    letters. Whole columns are folded byte by byte through tables: thousands of characters in a pattern or a translation cost a
    search each for every character of a text.
    """
    return F.arrow_udf(_plain_names, "string")(col(value).cast("string"))


def joined(columns: Iterable[Column | str], bar: str = "|") -> Column:
    return F.concat_ws(bar, *[col(c) for c in columns])


def day_from_int(value: Column | str) -> Column:
    """Integer yyyymmdd to a date, invalid numbers to null."""
    text = col(value).cast("string")
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))


def hash_token(seed: str, *ids: Column | str) -> Column:
    """A reproducible pseudo-random text per id; the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[col(i).cast("string") for i in ids]))


def hash_number(token: Column, digits: int = 8) -> Column:
    """The leading hex digits of a token, 15 at most, as a bigint."""
    return F.conv(F.substring(token, 1, digits), 16, 10).cast("bigint")


def hash_unit(token: Column) -> Column:
    """A token as a number in [0, 1)."""
    return hash_number(token) / F.lit(4294967296.0)
