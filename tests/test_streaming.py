from datetime import datetime, timedelta, timezone

from tessel.sources.versioned import VersionedTable
from tessel.streaming.observations import OBSERVATION, STATE, STREAM, follow


def test_late_and_repeated_observations(spark, tmp_path):
    start = datetime(2025, 1, 1, tzinfo=timezone.utc)
    at = lambda n: start + timedelta(days=n)
    state = VersionedTable(spark, f"file://{tmp_path}/state", STATE)

    def write(*rows):
        spark.createDataFrame([(1, p, m, s, at(o), at(a)) for p, m, s, o, a in rows], OBSERVATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        query = follow(spark, f"{tmp_path}/in", state, f"{tmp_path}/checkpoint", once=True, vectors=1)
        query.awaitTermination(120)
        return {r.path: (r.mtime, r.size) for r in state.read().collect()}

    write(("a", 1.0, 1, 1, 1), ("b", 1.0, 1, 3, 3), ("b", 1.0, 1, 3, 3), (None, 1.0, 1, 1, 1))
    assert run() == {"a": (1.0, 1), "b": (1.0, 1)}
    write(("a", 2.0, 2, 2, 9), ("b", 0.5, 9, 2, 9), ("c", None, None, 1, 9))
    assert run() == {"a": (2.0, 2), "b": (1.0, 1), "c": (None, None)}
    version = state.latest()
    assert run()["a"] == (2.0, 2) and state.latest() == version and state.processed(STREAM) == 2 and state.state().deletions == []
