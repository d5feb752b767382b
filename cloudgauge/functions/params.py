"""The 13-value settings block: names, kinds and bounds."""

from __future__ import annotations

from dataclasses import dataclass

# Field names, order and bounds every result depends on.
PARAM_NAMES = [
    "low_shelf_gain",
    "low_shelf_freq",
    "band1_gain",
    "band1_freq",
    "band1_q",
    "band2_gain",
    "band2_freq",
    "band2_q",
    "band3_gain",
    "band3_freq",
    "band3_q",
    "high_shelf_gain",
    "high_shelf_freq",
]
ANSWER_BOUNDS = {"gain": (-12.0, 12.0), "freq": (0.0, 20000.0), "q": (0.1, 10.0)}
REGRESSOR_BOUNDS = {"gain": (-12.0, 12.0), "freq": (20.0, 20000.0), "q": (0.1, 10.0)}
RAW_GAIN_LIMIT = 15.0
FLAT_SETTINGS = {
    "low_shelf_gain": 0.0,
    "low_shelf_freq": 120.0,
    "band1_gain": 0.0,
    "band1_freq": 250.0,
    "band1_q": 0.71,
    "band2_gain": 0.0,
    "band2_freq": 1000.0,
    "band2_q": 0.71,
    "band3_gain": 0.0,
    "band3_freq": 3500.0,
    "band3_q": 0.71,
    "high_shelf_gain": 0.0,
    "high_shelf_freq": 10000.0,
}

GAINS = [n for n in PARAM_NAMES if n.endswith("_gain")]
FREQS = [n for n in PARAM_NAMES if n.endswith("_freq")]
QS = [n for n in PARAM_NAMES if n.endswith("_q")]


def kind(name: str) -> str:
    return name.rsplit("_", 1)[1]


@dataclass(frozen=True)
class Band:
    """One filter of the chain and the columns that set it."""

    shape: str  # low_shelf | peaking | high_shelf
    gain: str
    freq: str
    q: str | None = None


BANDS = [
    Band("low_shelf", "low_shelf_gain", "low_shelf_freq"),
    Band("peaking", "band1_gain", "band1_freq", "band1_q"),
    Band("peaking", "band2_gain", "band2_freq", "band2_q"),
    Band("peaking", "band3_gain", "band3_freq", "band3_q"),
    Band("high_shelf", "high_shelf_gain", "high_shelf_freq"),
]
