"""lectio: ordinal text-readability analytics as lazy Spark DataFrame transforms.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregations and windows.  Sub-packages:

* ``lectio.functions`` – column expressions (segmentation, normalisation,
  tokenisation, level mapping, hashing keys).
* ``lectio.operators`` – table operators (lexicon lookups, feature vectors,
  morphological rewrite, roll-ups, ordinal metrics, splits, encoding, models).
* ``lectio.sources``   – readers and writers (CSV/TSV/Parquet, BOM, tolerant
  scans, optional sources, compute-once stages, submission sinks) and the
  doc_id-bucketed layout that makes scoring plans shuffle-free.
* ``lectio.plans``     – end-to-end pipelines and the fixture tables derived
  from the driver's data.
* ``lectio.streaming`` – the same scoring plan run incrementally.
* ``lectio.cli``       – ``python -m lectio``: prepare, train, predict, evaluate
  on files in the reference's input schemas.
"""

from lectio.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
