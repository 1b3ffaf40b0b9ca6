"""Sky colours: bracketed palettes, then blends by the weather, which are a table of data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.functions.text import hex_to_rgb, lerp_rgb
from skyloom.operators.joins import bracket_join

STOPS = range(4)

#: Fixed values, in the order of the blends: weight, mix, and by stop (0 is the zenith, 3 the horizon) the share of the
#: weight and the target, from one colour at mix 0 to another at mix 1.
LAYERS = [
    ("snow", None, {0: (1.0, "#586878"), 1: (1.0, "#6a7888"), 2: (1.0, "#7a8898"), 3: (1.0, "#8890a0")}),
    ("cloud", "cover", {0: (1.0, "#3a4a68", "#404858"), 1: (1.0, "#4a5a78", "#4a5468"), 2: (1.0, "#506080", "#546070"), 3: (1.0, "#586888", "#586478")}),
    ("middle", None, {0: (1.0, "#3a4868"), 1: (1.0, "#4a5a80"), 2: (1.0, "#5a6a90"), 3: (1.0, "#5a7090")}),
    ("high", None, {0: (1.0, "#4a6098"), 1: (1.0, "#5a70a8"), 2: (1.0, "#6a80b0"), 3: (1.0, "#6888b0")}),
    ("humid", None, {0: (1.0, "#3a5890"), 1: (1.0, "#4a6898"), 2: (1.0, "#5a78a0"), 3: (1.0, "#6888a8")}),
    ("mist", None, {0: (1.0, "#586878"), 1: (1.0, "#687888"), 2: (1.0, "#788890"), 3: (1.0, "#889098")}),
    ("warm", "dusk", {1: (0.20, "#c86e92"), 2: (0.30, "#ffab62", "#ff8a54"), 3: (0.34, "#ff7a34", "#ff5a26")}),
    ("dark", "dusk", {2: (0.30, "#8a6c58"), 3: (0.55, "#b0784a", "#a8663f")}),
    ("glow", None, {1: (0.13, "#5a3a70"), 2: (0.27, "#c0586a"), 3: (0.40, "#e85226")}),
    ("purple", None, {2: (0.22, "#4a2858"), 3: (0.22, "#5a3058")}),
    ("violet", None, {0: (0.22, "#3a2a55"), 1: (0.26, "#8a5a82")}),
]
#: Values of the weather where an observation has none.
DEFAULTS = {"cl": 0.0, "cm": 0.0, "ch": 0.0, "rh": 50.0, "vis_m": 30000.0, "pr": 0.0, "sn": 0.0}


def clamped(x: np.ndarray) -> np.ndarray:
    """Within [0, 1]; no number is 0."""
    return np.fmin(1.0, np.fmax(0.0, x))


def smoothstep(e0: float, e1: float, x: np.ndarray) -> np.ndarray:
    t = clamped((x - e0) / (e1 - e0))
    return t * t * (3 - 2 * t)


def weights(sun_alt: np.ndarray, evening: np.ndarray, cl: np.ndarray, cm: np.ndarray, ch: np.ndarray, rh: np.ndarray, vis_m: np.ndarray, pr: np.ndarray, sn: np.ndarray) -> dict[str, np.ndarray]:
    """Weights and mixes of the layers from the columns of DEFAULTS; 0 where a layer has no say."""
    zero = lambda x: np.fmax(0.0, x)
    day, cover = smoothstep(-3, 4, sun_alt), smoothstep(20, 100, cl)
    rain = clamped(pr / 1.2)
    warm = zero(1 - np.abs(sun_alt - 1) / 9) * zero(1 - np.abs((cm + ch) / 2 - 55) / 55) * (1 - smoothstep(90, 100, cl))
    dark = smoothstep(82, 100, cl) * zero(1 - np.abs(sun_alt) / 4)
    dusk = evening.astype(np.float64)
    return {
        "cover": cover,
        "dusk": dusk,
        "snow": np.where(sn > 0, np.fmin(0.8, sn / 2), 0.0),
        "cloud": np.where(sn <= 0, np.fmin(0.85, cover * 0.68 + rain * 0.18) * day, 0.0),
        "middle": smoothstep(30, 100, cm) * 0.35 * day,
        "high": smoothstep(25, 100, ch) * 0.25 * day,
        "humid": smoothstep(65, 100, rh) * 0.30 * smoothstep(1, 6, sun_alt),
        "mist": smoothstep(8, 0, vis_m / 1609.34) * 0.50 * day,
        "warm": np.where(warm > 0.02, warm, 0.0),
        "dark": np.where(dark > 0.02, dark, 0.0),
        "glow": dusk * np.where(sun_alt >= -1, zero(1 - (sun_alt + 1) / 9), zero(1 + (sun_alt + 1) / 11)),
        "purple": dusk * zero(1 - np.abs(sun_alt + 5) / 5),
        "violet": dusk * zero(1 - np.abs(sun_alt + 3) / 4),
    }


def rgb(colour: str) -> list[int]:
    return [int(colour[n : n + 2], 16) for n in (1, 3, 5)]


def blend(x: np.ndarray, to: np.ndarray | float, weight: np.ndarray) -> np.ndarray:
    """As ``lerp_rgb``: towards ``to`` by the weight clamped to [0, 1], rounded half up."""
    return np.floor(x + (to - x) * np.clip(weight, 0.0, 1.0) + 0.5)


def fold_layers(named: dict[str, np.ndarray], channels: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """All layers in order over arrays of channels, by stop."""
    for weight, mix, stops in LAYERS:
        for stop, (share, low, *high) in stops.items():
            for i, start in enumerate(rgb(low)):
                to = blend(np.float64(start), rgb(high[0])[i], named[mix]) if high else start
                channels[stop][i] = blend(channels[stop][i], to, named[weight] * share)
    return channels


def sky_gradient(obs: DataFrame, palette: DataFrame, sun_alt: str = "sun_alt") -> DataFrame:
    """Four colours from zenith to horizon.  obs: sun_alt, evening, cl, cm, ch, rh, vis_m, pr, sn; nulls have defaults.
    palette: alt, c0..c3 as #rrggbb.  Weights and layers are worked out over whole Arrow batches."""
    parsed = palette.select("alt", *(v.alias(f"_p{i}{n}") for i in STOPS for n, v in enumerate(hex_to_rgb(F.col(f"c{i}")))))
    if hasattr(palette, "_literal_rows"):
        parsed._literal_rows = palette._literal_rows
    df = bracket_join(obs, parsed, sun_alt)
    told = [F.col(sun_alt).cast("double"), F.coalesce("evening", F.lit(False)), *(F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in DEFAULTS.items())]
    starts = [lerp_rgb([F.col(f"_p{i}{n}")], [F.col(f"next__p{i}{n}")], F.col("t"))[0].cast("double") for i in STOPS for n in range(3)]
    rows = df.select(*obs.columns, *(c.alias(f"_w{i}") for i, c in enumerate([*told, *starts])))
    kept, n_told = list(obs.columns), len(told)
    keep = len(kept)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns[keep:]]
            cells = arrays[n_told:]
            folded = fold_layers(weights(*arrays[:n_told]), [cells[3 * i : 3 * i + 3] for i in STOPS])
            skies = [pa.array((r * 65_536 + g * 256 + b).astype(np.int64)) for r, g, b in folded]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *skies], names=[*kept, *(f"sky{i}" for i in STOPS)])

    schema = StructType([df.schema[c] for c in obs.columns])
    for i in STOPS:
        schema = schema.add(f"sky{i}", "long")
    hexed = lambda c: F.concat(F.lit("#"), F.lower(F.lpad(F.hex(c), 6, "0")))
    return rows.mapInArrow(fold, schema).select(*obs.columns, *(hexed(f"sky{i}").alias(f"sky{i}") for i in STOPS))
