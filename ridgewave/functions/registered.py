"""Functions and a table function for SQL: :func:`register` makes them known to a session.

Scalar functions are SQL expressions, which Catalyst inlines; kernels over arrays are Arrow functions; ``cfar_detect`` gives
the detections of one spectrum as rows and is used as ``FROM frames, LATERAL cfar_detect(psd)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name, arguments, result, expression.
SCALARS = (
    ("db", "x DOUBLE", "DOUBLE", "10 * log10(x + 1e-12)"),
    ("quantize_db", "x DOUBLE", "SMALLINT", "CAST(floor(greatest(0, least(255, (x + 120) / 100 * 255))) AS SMALLINT)"),
    ("dequantize_db", "level SMALLINT", "DOUBLE", "level / 255.0D * 100 - 120"),
    ("snr_severity", "snr DOUBLE", "STRING", "CASE WHEN snr > 25 THEN 'high' WHEN snr > 15 THEN 'medium' ELSE 'low' END"),
    ("advertising_mhz", "channel INT", "INT", "CASE channel WHEN 37 THEN 2402 WHEN 38 THEN 2426 WHEN 39 THEN 2480 ELSE 2404 + 2 * channel + IF(channel > 10, 2, 0) END"),
    ("safe_file_name", "name STRING", "STRING", r"regexp_replace(name, r'[^\p{L}\p{N}._-]', '_')"),
)


def register(spark: SparkSession, sample_rate: float = 64_000.0, reference: int = 8, guard: int = 2, pfa: float = 1e-2, merge_hz: float = 1000.0, min_snr_db: float = 3.0) -> None:
    """Register everything for this session; the detector's settings are those given here."""
    from ..operators.cfar import Cfar
    from ..operators.peaks import Peaks

    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    cfar, peaks = Cfar(reference, guard, pfa), Peaks(sample_rate, merge_hz=merge_hz, min_bins=1, min_snr_db=min_snr_db)

    @F.pandas_udf("array<double>")
    def cfar_threshold(psd: pd.Series) -> pd.Series:
        return psd.map(lambda x: cfar(np.asarray(x, float)[None, :])[1][0] if x is not None and len(x) else None)

    @F.pandas_udf("double")
    def mean_power_db(i: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([10 * np.log10(np.mean(np.square(a) + np.square(b)) + 1e-12) if a is not None and b is not None and len(a) else None for a, b in zip(i, q)])

    @F.udtf(returnType="start_bin int, end_bin int, peak_bin int, peak_power_db double, snr_db double, center_freq_hz double")
    class CfarDetect:
        def eval(self, psd: list):
            if psd:
                x = np.asarray(psd, float)
                for start, end, peak, power, snr, _, center, *_ in peaks(x, cfar(x[None, :])[3][0]):
                    yield start, end, peak, power, snr, center

    spark.udf.register("cfar_threshold", cfar_threshold)
    spark.udf.register("mean_power_db", mean_power_db)
    spark.udtf.register("cfar_detect", CfarDetect)
