"""Default parameters of the metrics.

Fixed values that must equal the reference for identical results:
  cost weights (w_in, w_out) = (1.0, 4.0)
  tokens per million for dollar prices = 1,000,000
  business view: beta = 0.8, k normalised per 20 tasks, efficiency gate = 0.05
  depth ladder: prune when accuracy <= 0.20, else when efficiency < 0.05;
                stop when pruned / alive > 0.5
  depth rungs of the ladder: 3 to 30 in steps of 3
  token heuristic: words * 1.3, truncated, at least 1 for non-empty text
"""

from __future__ import annotations

DEFAULT_WEIGHTS: tuple[float, float] = (1.0, 4.0)
TOKENS_PER_MILLION: float = 1_000_000.0

BETA: float = 0.8
PER_TASKS: int = 20
EFF_GATE: float = 0.05

LADDER_STOP_ACCURACY: float = 0.20
LADDER_STOP_EFFICIENCY: float = 0.05
LADDER_STOP_MAJORITY: float = 0.5
LADDER_DEPTHS: tuple[int, ...] = tuple(range(3, 31, 3))

TOKEN_WORD_FACTOR: float = 1.3
