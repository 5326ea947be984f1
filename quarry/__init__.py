"""quarry: retrieval-evaluation data sets and metrics as Spark DataFrame jobs.

Layout
------
functions/  Column -> Column building blocks (text, hashing, vectors)
sources/    scans and sinks (text corpora, CSV eval sets, JSON/markdown reports)
operators/  DataFrame -> DataFrame operators (parsing, query generation,
            training sets, retrieval, metrics, comparison)
plans/      end-to-end pipelines and the query catalogue over the test tables
streaming/  the stateless corpus -> eval-set operators on readStream
"""

from quarry.config import EvalConfig, DEFAULT_CONFIG  # noqa: F401
from quarry.session import get_session, scratch_dir  # noqa: F401
