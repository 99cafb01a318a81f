"""Fixed values of the analysis: windows, bins, boxes, scenarios and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

#: Trailing windows in days, and discrete lags.
MA_WINDOWS = (*range(1, 29), 30, 40, 50, 60, 75, 90)
LAGS = (1, 2, *range(3, 91, 3))
LAG_SMOOTH = 3

#: Bits of a cell's flags.
SAA, CONTROL_NORTH, POLAR, SAHARA, LOW_LAI, HIGH_LAI = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class Box:
    """Inclusive bounds in degrees."""

    south: float
    north: float
    west: float
    east: float


#: Boxes of the regions; latitude beyond which a cell is polar.
BOX_SAA = Box(-50.0, 0.0, -90.0, 10.0)
BOX_SAHARA = Box(15.0, 30.0, -15.0, 35.0)
BOX_CONTROL_WEST = Box(25.0, 60.0, -130.0, -60.0)
BOX_CONTROL_EAST = Box(25.0, 60.0, -10.0, 140.0)
POLAR_LATITUDE = 60.0

#: Scenario, required bits, forbidden bits.
SCENARIOS = (
    ("Global_High_LAI", HIGH_LAI, 0),
    ("SAA_High_LAI", SAA | HIGH_LAI, 0),
    ("Control_North", CONTROL_NORTH | HIGH_LAI, 0),
    ("Sahara_Barren", SAHARA | LOW_LAI, 0),
)

#: Upper edges of the temperature bins, right-closed, and their labels.
BIN_EDGES = (7.0, 15.0, 25.0, 30.0)
BIN_LABELS = ("Cold", "Cool", "Optimum", "Warm_Stress", "Extreme_Heat")
QUANTILE_BINS = 15

#: Thresholds of the joins and models.
LAI_VEGETATION, LAI_LEAST, CLOUD_MOST, AEROSOL_MOST, RATIO_LEAST = 0.15, 0.01, 60.0, 50.0, 0.001
RESOLUTION, CELL_STEP = 0.5, 50
MIN_OBSERVATIONS, NEFF_MAX_LAG = 40, 60
P_FLOOR = 1e-16
#: P up to which a line has an opacity.
P_OPACITY = ((1e-16, 1.0), (1e-8, 0.8), (1e-4, 0.6), (1e-2, 0.4), (0.05, 0.15))
#: The permutation test.
SURROGATES, SURROGATE_SEED, BAND_LOW, BAND_HIGH = 500, 12032026, 20, 30
SURROGATE_SCENARIOS, SURROGATE_LEAST = ("Global_High_LAI", "Control_North"), 100
