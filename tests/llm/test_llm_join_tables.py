"""What the similarity join hands its workers and leaves in the shared folder."""

import random

from steplake.llm import jaccard_join
from steplake.session import shared_folder
from steplake.sources import storage
from test_llm_text_operators import frame, near_copies


def tables(spark):
    return {name for name, *_ in storage.children(spark, f"{shared_folder(spark).rstrip('/')}/steplake") if name.startswith("jaccard-")}


def test_tables_between_the_steps_go(spark):
    before = tables(spark)
    found = jaccard_join.jaccard_components(frame(spark, near_copies(4, 40, 40)))
    left = {name.split("-")[1] for name in tables(spark) - before}
    assert left <= {"swept", "linked"}
    assert found.count() == found.select("doc_id").distinct().count() > 0


def test_workers_get_rows_by_their_bytes(spark, monkeypatch):
    def watched(real):
        def made(*args):
            run = real(*args)

            def checked(batches):
                def small():
                    for batch in batches:
                        assert batch.nbytes < 4 << 20, f"{batch.nbytes} bytes at once"
                        yield batch
                return run(small())
            return checked
        return made

    for name in ("_swept", "_sets", "_bounded", "_linked"):
        monkeypatch.setattr(jaccard_join, name, watched(getattr(jaccard_join, name)))
    rng = random.Random(5)
    docs = {i: " ".join(f"{rng.randrange(10**9):0100d}" for _ in range(2000)) for i in range(60)}
    docs |= {100 + i: docs[i] + " end" for i in range(0, 60, 2)}
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, docs).coalesce(1)).collect()}
    assert got == {d: d % 100 for d in docs} and spark.conf.get(key, None) == was
