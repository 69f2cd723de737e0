"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the bytes of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ebbtide.llm.blocks import BLOCK_BYTES, decode, encode, parts_of, slices
from ebbtide.llm.kernels import HashTable, bytes_of
from ebbtide.session import pin

ORDER = 5
#: Orders whose tables have a proven size: 256 ** 2 grams of two bytes.
BOUNDED = 2
#: Text of one group: large enough that it asks for few grams against its size, small enough for one task.
GROUP_BYTES = 16 << 20
#: Rows of trusted ids that are broadcast; more are joined by a shuffle of both sides.
FEW_IDS = 2_000_000


def byte_grams(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For every byte, itself and the ``ORDER - 1`` bytes before it as one number; a text begins after line feeds."""
    lead = ORDER - 1
    padded = np.full(len(data) + lead * (len(cuts) - 1), 10, dtype=np.uint8)
    place = np.arange(len(data)) + lead * (1 + np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)))
    padded[place] = data
    wide = padded.astype(np.uint64)
    grams = np.zeros(len(padded) - lead if len(padded) > lead else 0, dtype=np.uint64)
    for step in range(ORDER):
        grams = grams << np.uint64(8) | wide[step:step + len(grams)]
    return grams[place - lead]


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; sorting numbers is faster here than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def distinct_grams(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a batch and how often each occurs, slice by slice."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in slices(batch, text, BLOCK_BYTES):
        more, times = np.unique(byte_grams(*bytes_of(part.column(text))), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
    return keys, counts


def _low(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


class KneserNey:
    """Counts of every order as small tables, and the discounts from their counts of counts."""

    def __init__(self, texts: DataFrame, text: str) -> None:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, counts = distinct_grams(batch, text)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["gram", "c"])

        # the highest order has occurrences, each lower one the number of different bytes before its gram
        own = texts.select(text).mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
        self.counts = {ORDER: pin(own)}
        for order in range(ORDER - 1, 0, -1):
            shorter = _low(F.col("gram"), order).alias("gram")
            self.counts[order] = pin(self.counts[order + 1].groupBy(shorter).agg(F.count(F.lit(1)).alias("c")))
        self.discounts = {}
        for order, grams in self.counts.items():
            n = grams.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
            base = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            # where counts of counts give no discount between 0 and the count, the plain one stands in: never 0
            made = [i - (i + 1) * base * n[i] / n[i - 1] if n[i - 1] else 0.0 for i in (1, 2, 3)]
            self.discounts[order] = [d if 0 < d <= i else base for i, d in enumerate(made, 1)]

    def log_probability(self, grams: DataFrame) -> DataFrame:
        """(gram, _group, logp) for distinct grams.

        An order is scored once per distinct gram of that order, from the scores one order below, so only the highest order moves
        all asked grams. Tables with at most 256 ** 2 rows (grams of two bytes, contexts of two) are broadcast: that bound
        holds for any corpus.
        """
        asked = {ORDER: grams}
        for order in range(ORDER - 1, BOUNDED, -1):
            asked[order] = asked[order + 1].select(_low(F.col("gram"), order).alias("gram")).distinct()
        scored = asked[BOUNDED + 1].withColumn("_p", F.lit(1.0 / 256))
        for order in range(1, BOUNDED + 2):
            scored = self._scored(scored, order, F.col("gram") if order > BOUNDED else _low(F.col("gram"), order))
        for order in range(BOUNDED + 2, ORDER + 1):
            below = scored.select(F.col("gram").alias("_below"), "_p")
            scored = self._scored(asked[order], order, F.col("gram"), below)
        return scored.select("gram", "_group", F.ln("_p").cast("float").alias("logp"))

    def _scored(self, rows: DataFrame, order: int, gram: Column, below: DataFrame | None = None) -> DataFrame:
        """``rows`` with the probability ``_p`` of an order in place of the one below, which stands in the rows or in ``below``."""
        d1, d2, d3 = self.discounts[order]
        c = F.col("c")
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        table = self.counts[order]
        own = table.select(F.col("gram").alias("_own"), (c - cut).alias("_a"))
        context = table.groupBy(F.shiftright("gram", 8).alias("_context")).agg(F.sum("c").alias("_s"), F.sum(cut).alias("_m"))
        out = rows.join(F.broadcast(own) if order <= BOUNDED else own, gram == F.col("_own"), "left")
        if below is not None:
            out = out.join(below, _low(gram, order - 1) == F.col("_below"))
        out = out.join(
            F.broadcast(context) if order <= BOUNDED + 1 else context, F.shiftright(gram, 8) == F.col("_context"), "left"
        )
        p = F.when(F.col("_s").isNull(), F.col("_p")).otherwise(
            (F.coalesce("_a", F.lit(0.0)) + F.col("_m") * F.col("_p")) / F.col("_s")
        )
        return out.select(*rows.columns, p.alias("_p")) if below is not None else out.withColumn("_p", p).select(*rows.columns)


def merged(payloads: Iterable[pa.Scalar], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of encoded batches in batches of about ``limit`` bytes of text, however small each payload is."""
    held, size = [], 0

    def put() -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield from slices(batch, text, limit)

    for payload in payloads:
        held.append(decode(payload.as_buffer()))
        size += held[-1].column(text).nbytes
        if size >= limit:
            yield from put()
            held, size = [], 0
    yield from put()


def groups_of(docs: DataFrame, text: str) -> int:
    """As many groups as there are ``GROUP_BYTES`` of text."""
    return 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // GROUP_BYTES


def _with_group(doc_id: str, text: str, groups: int) -> Column:
    # the text takes part: rows without an id are many groups
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(groups)).cast("int").alias("_group")


def perplexity(docs: DataFrame, model: KneserNey, text: str, doc_id: str, carry: Sequence[str]) -> DataFrame:
    """doc_id, ``carry``, n_bytes and logp (the sum over the bytes; 0 for null and empty texts).

    Documents are dealt to groups of about ``GROUP_BYTES`` by a hash of id and text. A group asks for its distinct grams; the answers,
    made once per distinct gram of all documents, come back to the group. The two uses of the dealt documents share one shuffle.
    """
    parts, names = parts_of(docs), list(dict.fromkeys([doc_id, *carry, text]))
    inner = docs.select(_with_group(doc_id, text, groups_of(docs, text)), *[F.col(c) for c in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("_group").to_numpy()
            order = np.argsort(group, kind="stable")
            group, rows = group[order], batch.take(pa.array(order))
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[a:a + 1]), pa.array([encode(rows.slice(a, b - a))], pa.binary())], ["_group", "payload"]
                )

    packed = inner.mapInArrow(pack, "_group int, payload binary").repartition(parts, "_group")

    def wanted(table: pa.Table) -> pa.Table:
        keys = np.zeros(0, np.uint64)
        # a group has a payload of every batch of the input: merged first, so the work follows the text and not their number
        for part in merged(table["payload"], text, BLOCK_BYTES):
            keys = distinct_keys(np.concatenate([keys, distinct_keys(byte_grams(*bytes_of(part.column(text))))]))
        return pa.table({"_group": pa.array(np.full(len(keys), table["_group"][0].as_py(), np.int32)), "gram": keys.astype(np.int64)})

    # never null, so no join adds a filter of its own: all uses of the asked grams read one and the same shuffle
    ask = StructType([StructField("_group", IntegerType(), False), StructField("gram", LongType(), False)])
    asked = packed.groupBy("_group").applyInArrow(wanted, ask).repartition(parts, "gram")
    distinct = asked.groupBy("gram").agg(F.min("_group").alias("_group")).where("_group >= 0")
    answers = model.log_probability(distinct).select("gram", "logp")
    told = asked.join(answers, "gram")
    schema = StructType([*[docs.schema[c] for c in names if c != text], StructField("n_bytes", LongType()), StructField("logp", DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        table = HashTable(known["gram"].to_numpy().astype(np.uint64), known["logp"].to_numpy().astype(np.float64))
        out = []
        for part in merged(rows["payload"], text, BLOCK_BYTES):
            data, cuts = bytes_of(part.column(text))
            sums = np.concatenate([[0.0], np.cumsum(table.get(byte_grams(data, cuts), np.nan))])
            columns = [*[part.column(c) for c in names if c != text], pa.array(np.diff(cuts)), pa.array(sums[cuts[1:]] - sums[cuts[:-1]])]
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    return packed.groupBy("_group").cogroup(told.groupBy("_group")).applyInArrow(score, schema)


def quality_scores(
    docs: DataFrame,
    trusted: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    quantile: float = 0.99,
    margin: float = 1.05,
    short: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, lang, n_bytes, log_perplexity, limit, kept and the ``carry`` columns of every document.

    A document is kept while its log perplexity per byte less ``short / sqrt(n_bytes)``, because short texts vary
    more, is within the limit of its language.

    ``trusted`` names the ids of trusted documents. Four fifths of them (by a hash of the id) train the model, on all their
    text; the same figure of the others, which the model has not seen, gives the limit of a language: ``margin`` times
    its ``quantile``. A language without such documents takes the limit over all; without
    any, every document is kept. Null and empty texts have no perplexity (null) and are kept; a null language is a
    language. Rows are judged one by one, repeated or not; other columns do not take part.
    """
    ids = pin(trusted.select(F.col(doc_id).alias("_trusted")).where(F.col("_trusted").isNotNull()).distinct())
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_trusted")), F.lit(5))
    small = len(ids.select(F.lit(1)).take(FEW_IDS + 1)) <= FEW_IDS
    train = ids.where(fold != 0)
    texts = docs.select(doc_id, text).join(F.broadcast(train) if small else train, F.col(doc_id) == F.col("_trusted"), "left_semi")
    model = KneserNey(texts, text)
    inner = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"),
                        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)])
    scored = perplexity(inner, model, "_text", "_id", ["_lang", *[f"_carry_{i}" for i in range(len(carry))]])
    scored = pin(scored.withColumn("_lp", F.when(F.col("n_bytes") > 0, -F.col("logp") / F.col("n_bytes"))))
    figure = F.col("_lp") - F.lit(short) / F.sqrt("n_bytes")
    held = scored.join(ids.where(fold == 0), F.col("_id") == F.col("_trusted"), "left_semi").where("_lp is not null")
    high = (F.percentile_approx(figure, quantile, 10_000) * margin).alias("_limit")
    by_lang = held.groupBy("_lang").agg(high)
    over_all = held.agg(high).first()[0]
    limit = F.coalesce("_limit", F.lit(over_all).cast("double"))
    return scored.alias("s").join(by_lang.alias("l"), F.col("s._lang").eqNullSafe(F.col("l._lang")), "left").select(
        F.col("_id").alias(doc_id), F.col("s._lang").alias(lang), "n_bytes", F.col("_lp").alias("log_perplexity"), limit.alias("limit"),
        F.coalesce(figure <= limit, F.lit(True)).alias("kept"), *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )
