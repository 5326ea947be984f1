from quarry.streaming.evalset_stream import (corpus_stream, eval_set_stream, numbered_entries,  # noqa: F401
                                             start_eval_set_sink, start_numbered_sink)
from quarry.streaming.responses_stream import responses_stream, start_ledger_sink, test_set_stream  # noqa: F401
