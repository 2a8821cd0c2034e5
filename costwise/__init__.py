"""costwise: evaluation economics as Spark DataFrame operators.

Tables of tasks, model responses and price sheets go in; graded results,
dollar economics, leaderboards, difficulty pivots, depth-ladder decisions and
audits come out, all as lazy DataFrames that Catalyst plans end to end.

Layout:
  functions/  Column builders (row-level rules, no actions)
  sources/    readers / writers and the fixture views over the test tables
  operators/  DataFrame-in / DataFrame-out operators (joins, aggregates, windows)
  plans/      the registered query plans and their SQL oracles
  streaming/  Structured Streaming variants of scoring and running reports
"""

from costwise.session import build_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
