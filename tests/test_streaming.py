import os
import tempfile

from lectio.plans import fixtures as fx
from lectio.streaming.scoring import score_batch, start_scoring
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    lex = fx.derived_lexicon(fx.documents(spark, SF_SMALL)).cache()
    work = tempfile.mkdtemp(prefix="lectio-stream-")
    src = os.path.join(work, "in")
    fx.documents(spark, SF_SMALL).repartition(4).write.parquet(src)
    q = start_scoring(spark, src, lex, os.path.join(work, "out"), os.path.join(work, "ckpt"),
                      max_files_per_trigger=1)
    q.awaitTermination(300)
    got = sorted((r.doc_id, r.level) for r in spark.read.parquet(os.path.join(work, "out")).collect())
    want = sorted((r.doc_id, r.level) for r in score_batch(fx.documents(spark, SF_SMALL), lex).collect())
    assert got == want


def test_stream_resumes_from_checkpoint(spark):
    lex = fx.derived_lexicon(fx.documents(spark, SF_SMALL)).cache()
    docs = fx.documents(spark, SF_SMALL)
    work = tempfile.mkdtemp(prefix="lectio-stream-resume-")
    src, out, ckpt = (os.path.join(work, d) for d in ("in", "out", "ckpt"))
    docs.filter("doc_id % 2 = 0").write.parquet(os.path.join(src, "part=a"))
    start_scoring(spark, src, lex, out, ckpt).awaitTermination(300)
    first = spark.read.parquet(out).count()
    # new files arrive; the restarted query reads only those
    docs.filter("doc_id % 2 = 1").write.parquet(os.path.join(src, "part=b"))
    start_scoring(spark, src, lex, out, ckpt).awaitTermination(300)
    got = sorted((r.doc_id, r.level) for r in spark.read.parquet(out).collect())
    want = sorted((r.doc_id, r.level) for r in score_batch(docs, lex).collect())
    assert first == docs.filter("doc_id % 2 = 0").count()
    assert got == want  # every document exactly once
