"""A corpus described: torn texts, letters and digits, counters, the command over folders, settings files."""

import json
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura import config
from murmura.__main__ import main
from murmura.functions import text as T
from murmura.operators import description as D
from murmura.sources import audio

TEXTS = ["a [hum] b", "[hum]a[ sigh ] b [", "]", "", None, "x [a [b] c] d", "[]", "one  two [Hum][hum] ", "t[u v", "é ß [hum]ß"]


def by_hand(text):
    """Words and events with tags cut out one by one."""
    text = text or ""
    own, events, at = [], [], 0
    for m in re.finditer(r"\[[^\[\]]*\]", text):
        own += text[at : m.start()].split()
        events.append((m[0][1:-1].strip().lower(), len(own)))
        at = m.end()
    return own + text[at:].split(), events


def rows(spark):
    return spark.createDataFrame([("train" if i % 3 else "dev", f"p{i % 2}", f"{i}.wav", t, "vi" if i % 4 else None, "note|take" if i == 2 else "", ) for i, t in enumerate(TEXTS)], "split string, speaker string, audio string, tagged string, lang string, more string")


def test_torn_texts_keep_their_words(spark):
    got = {r.audio: r for r in D.analysed(rows(spark), None, "de").collect()}
    for i, t in enumerate(TEXTS):
        own, events = by_hand(t)
        r = got[f"{i}.wav"]
        assert (r.words, r.clean, [(e.type, e.gap, e.e) for e in r.events]) == (len(own), " ".join(own), [(k, g, e) for e, (k, g) in enumerate(events)]), t
        assert r.foreign == sorted({c for c in r.clean.lower() if c.isalpha() and c not in T.alphabet("de")})[:10]
    assert got["9.wav"].foreign == ["é"] and got["1.wav"].bracket and not got["9.wav"].decomposed
    assert T.alphabet("vi").count("đ") == 1 and len(set(T.alphabet("vi"))) == 26 + 67


def test_tables_of_a_corpus(spark):
    infos = spark.createDataFrame([(f"{i}.wav", 16000, 1, 16, 100, float(i), None) for i in range(8)] + [("8.wav", None, None, None, None, None, "torn samples")], "clip string, rate int, channels int, bits int, frames long, seconds double, error string")
    own = D.analysed(rows(spark), infos, "de").cache()
    assert {r.audio for r in own.where("NOT there").collect()} == {"9.wav"} and own.where("file_error IS NOT NULL").first().audio == "8.wav"
    over = {r.split: r for r in D.overview(own).collect()}
    assert over["train"].utterances == 6 and over["dev"].words == sum(len(by_hand(t)[0]) for i, t in enumerate(TEXTS) if i % 3 == 0) and over["dev"].hours == pytest.approx((0 + 3 + 6) / 3600)
    people = {r.speaker: r for r in D.speakers(own, ["train", "dev"], ["hum", "sigh"]).collect()}
    assert (people["p1"].train_n, people["p1"].dev_n, people["p1"].train_hum, people["p1"].train_sigh) == (3, 2, 3, 1) and people["p1"].train_minutes == pytest.approx((1 + 5 + 7) / 60)
    tags = {(r.type, r.split): r for r in D.tags(own, ["hum"]).collect()}
    assert tags["hum", "train"].n == 3 and tags["hum", "train"].per_minute == pytest.approx(3 / ((1 + 2 + 4 + 5 + 7) / 60)) and tags["sigh", "train"].unlisted and tags["hum", "train"].at_start == 1
    measured = {(r.split, r.measure): r for r in D.measures(own).collect()}
    rates = [len(by_hand(TEXTS[i])[0]) / i for i in (3, 6)]
    assert measured["dev", "words_per_second"].n == 2 and measured["dev", "words_per_second"].p50 == pytest.approx(np.median(rates)) and measured["dev", "words"].p100 == max(len(by_hand(TEXTS[i])[0]) for i in (0, 3, 6, 9))
    assert {(r.split, r.what, r.value): r.n for r in D.counters(own).collect()} == {("dev", "language", None): 1, ("dev", "language", "vi"): 3, ("train", "language", None): 2, ("train", "language", "vi"): 4, ("train", "key", "note"): 1, ("train", "key", "take"): 1}
    assert {(r.rate, r.error): r.n for r in D.formats(infos).collect()} == {(16000, None): 8, (None, "torn samples"): 1}
    assert {r.split: r.repeated for r in D.repeated(own).collect()} == {"dev": 1, "train": 0}
    assert {r.split: r.empty for r in D.quality(own).collect()} == {"dev": 2, "train": 1}


def test_digits(spark):
    chars = [chr(i) for i in range(32, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) in ("Nd", "No", "Nl", "Lu", "Sc")]
    got = {r.c for r in spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(T.digit())).collect()}
    assert got == {c for c in chars if c.isdigit()} and "²" in got and "½" not in got


def test_report_command(spark, tmp_path, capsys):
    for split, texts in (("train", ["xin [laughter] chào", "torn [ text"]), ("dev", ["xin chào"])):
        (tmp_path / "c" / split / "ann").mkdir(parents=True)
        (tmp_path / "c" / split / "ann" / "ann.json").write_text(json.dumps([{"audio": f"{k}.wav", "text": t, "language": "vi", "take": "2"} for k, t in enumerate(texts)]))
        (tmp_path / "c" / split / "ann" / "0.wav").write_bytes(audio.wav(np.zeros(8000), 16_000))
    assert main(["corpus-report", "--root", str(tmp_path / "c"), "--out", str(tmp_path / "out")], spark) == 0
    text = capsys.readouterr().out
    assert all(f"\n{t}\n" in text for t in ("overview", "tags", "measures", "quality", "counters", "repeated", "formats", "problems"))
    own = spark.read.option("header", True).csv(str(tmp_path / "out" / "utterances")).collect()
    assert len(own) == 3 and {r.seconds for r in own} == {"0.5", None} and {r["types"] for r in own} == {"laughter", None}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "speakers")).first().train_laughter == "1"
    assert {r.split: r.hours for r in spark.read.json(str(tmp_path / "out" / "summary")).collect()}["dev"] == pytest.approx(0.5 / 3600)


def test_settings_as_toml(tmp_path):
    (tmp_path / "a.toml").write_text('track = "B"\n[nvpa]\ntolerance = "0:1"\n')
    assert config.load(str(tmp_path / "a.toml"))["nvpa"]["tolerance"] == "0:1"
    (tmp_path / "b.toml").write_text("[nvpa]\nunknown = 1\n")
    with pytest.raises(ValueError, match="unknown setting"):
        config.load(str(tmp_path / "b.toml"))
    (tmp_path / "c.yaml").write_text("track: B\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError, match="no library"):
            config.load(str(tmp_path / "c.yaml"))
    else:
        assert config.load(str(tmp_path / "c.yaml"))["track"] == "B"
