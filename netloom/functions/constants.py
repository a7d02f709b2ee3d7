"""Constants of the library (fixed values)."""

from __future__ import annotations

import math

PICARD_TOL = 1e-6
ATOL = 1e-6
#: Of a node in an ego object: standardised covariate, standardised outcome, root mark.
NODE_FEATURES = 3
ROOT_MARK = 2
#: Steps of the smoothing of loss curves, and of the tail that estimates are averaged over.
ROLLING_WINDOW = 120
TAIL_WINDOW = 100
#: Losses of a test function that can't tell the sides apart.
OPTIMUM_D = 2 * math.log(2)
OPTIMUM_G = math.log(2)
OPTIMUM_G_SATURATING = -math.log(2)
FIGURE_DPI = 150
TABLE_SUFFIX, FIGURE_SUFFIX, MANIFEST = ".csv", ".png", "run_manifest.json"
