"""Frames of files in one pass."""

import numpy as np
import pytest

from murmura.operators import acoustics as A
from murmura.sources import audio


@pytest.mark.parametrize("rate", [16_000, 11_025])
def test_frames_of_files_are_one_pass_and_what_three_give(spark, rate):
    rng = np.random.default_rng(1)
    clips = [(f"c{n}", audio.wav(rng.uniform(-1, 1, n), rate)) for n in (1, 399, 400, 16_001, 150_000)] + [("torn", b"RIFF"), ("none", None)]
    found = spark.createDataFrame(clips, "clip string, content binary")
    one = A.frames_of_files(found)
    three = A.frames(A.resampled(audio.decoded(found, A.RATE, audio.BLOCK, A.FRAME - A.HOP), A.RATE))
    passes = [d._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for d in (one, three)]
    assert passes == [1, 3]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, three.collect())) and one.count() > 900
