"""The segmentation job and its detectors on inputs of few, short and equal lines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.jobs import files
from seqloom.operators import boundary, detectors


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


@pytest.mark.parametrize(("text", "wanted"), [
    ("1\n2\n1\n", ["1", "2", "1"]),
    ("1, 2, 1, 2\n2, 1, 2\n", None),
    ("", []),
    ("\n\n", ["", ""]),
    ("3 4\n3 4\n3 4\n3 4\n3 4\n", ["3 | 4"] * 5),
    ("7 8\n", ["7 | 8"]),
])
def test_segmentation_of_small_files(spark, tmp_path, text, wanted):
    (tmp_path / "in.txt").write_text(text)
    (tmp_path / "map.txt").write_text("1\t0.5\n2\t0.25\n")
    files.segmentation(spark, str(tmp_path / "in.txt"), str(tmp_path / "map.txt"), str(tmp_path / "map.txt"), str(tmp_path / "out"))
    found = lines(tmp_path / "out" / "segmented")
    given = text.split("\n")[:-1]
    assert [x.replace(" | ", ", ").replace(", ", " ") for x in found] == [x.replace(", ", " ") for x in given]
    assert found == wanted if wanted is not None else all("|" in x for x in found)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_detectors_of_few_rows(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame(rng.normal(size=(2, 13)), columns=boundary.FEATURES)
    frame.insert(0, "pos", 1)
    frame.insert(0, "seq_id", range(2))
    f = spark.createDataFrame(frame).withColumn("pos", F.col("pos").cast("int")).filter(F.col("seq_id") < n)
    found = {"m": detectors.gmm_detector(f), "d": detectors.density_detector(f), "z": (boundary.zscore_detector(f), boundary.zscore_reliability(f))}
    rel = {k: r.first().reliability for k, (_, r) in found.items()}
    assert all(p.count() == n and p.filter("p < 0 OR p > 1 OR p IS NULL").isEmpty() for p, _ in found.values())
    if n < 2:  # a single row: the z-score's 0.2, and a median distance of 0 for the clusters
        assert rel == ({"m": 0.0, "d": 0.0, "z": 0.0} if n == 0 else {"m": 0.2, "d": 0.1, "z": 0.2})
    assert boundary.ensemble(found).count() == n


def test_ensemble_without_detectors():
    with pytest.raises(ValueError, match="detector"):
        boundary.ensemble({})
