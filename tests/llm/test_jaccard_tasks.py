"""The n-gram join runs in as many tasks as its rows need."""

from __future__ import annotations

from ebbtide.llm.jaccard_join import jaccard_components


def test_tasks_follow_rows_at_many_shuffle_partitions(spark, documents):
    """Few near copies run in few tasks where Spark does not merge shuffle partitions; components stay the same."""
    body = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*body, f"end{i}"] if i < 40 else [f"x{i}y{j}" for j in range(30)]), "a") for i in range(80)]
    docs, context, many = documents(rows), spark.sparkContext, 48
    held = {"spark.sql.shuffle.partitions": str(many), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        context.setJobGroup("jaccard-tasks", "tasks of a small join")
        found = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    status = context.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("jaccard-tasks")]
    stages = [status.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
    tasks = [s.numCompletedTasks for s in stages if s and s.numCompletedTasks]
    assert found == {i: 0 if i < 40 else i for i in range(80)}
    assert sum(tasks) < 3500, sorted(tasks)
