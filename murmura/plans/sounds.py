"""Audio files made of the tables: headers and samples, resampling, frames and windows over frames."""

import uuid

from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import acoustics as A
from murmura.plans import read, spread
from murmura.registry import query
from murmura.sources import audio, sink
from murmura.storage import folder, kept

#: Scale of 16-bit samples when they are written.
FULL = 32767.0


def written(clips):
    """Files of clips (name, rate, x) in a new folder of the shared one, read back as clip (the name) and content; the driver lists none of them."""
    path = f"{folder(clips.sparkSession)}/sounds-{uuid.uuid4().hex}"
    return sink.read(sink.write(audio.encoded(clips), path), path).withColumnRenamed("name", "clip")


def word_clips(spark, sf_dir):
    """A clip of each document: a sample a word."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w, i: (((F.length(w) * 331 + i * 7) % 4001) - 2000) / F.lit(FULL))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"), (8000 + 1000 * (F.col("doc_id") % 3)).cast("int").alias("rate"), x.cast("array<float>").alias("x"))


@query("audio_probe", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM w),
made AS (SELECT doc_id, count(*) AS n, sum((len(w) * 331 + i * 7) % 4001 - 2000)::BIGINT AS total FROM s GROUP BY doc_id)
SELECT 8000 + 1000 * (doc_id % 3) AS rate, count(*) AS files, count(*) FILTER (n IS NULL) AS errors, sum(n)::BIGINT AS frames, round(sum(n / (8000 + 1000 * (doc_id % 3))::DOUBLE), 6) AS seconds, sum(total)::BIGINT AS total
FROM documents LEFT JOIN made USING (doc_id) GROUP BY ALL""")
def audio_probe(spark, sf_dir):
    """WAV files of all documents: headers against what was written, and the sum of all samples; a text without words is a file that can't be used."""
    found = kept(written(word_clips(spark, sf_dir)))
    heads = audio.probed(found)
    sums = audio.decoded(found).where("x IS NOT NULL").select("clip", F.aggregate("x", F.lit(0.0), lambda s, v: s + F.round(v * 32768)).alias("total")).groupBy("clip").agg(F.sum("total").alias("total"))
    number = F.regexp_extract("clip", r"d(\d+)", 1).cast("long")
    rate = (8000 + 1000 * (number % 3)).alias("rate")
    return heads.join(sums, "clip", "left").groupBy(rate).agg(
        F.count("*").alias("files"), F.count("error").alias("errors"), F.sum("frames").alias("frames"), F.round(F.sum("seconds"), 6).alias("seconds"), F.sum("total").cast("long").alias("total")
    )


def vector_clips(spark, sf_dir, rate):
    """Clips of 64 vectors each, a sample a component."""
    by = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("clip")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    s = F.transform(F.flatten(F.transform("v", lambda v: v["embedding"])), lambda c: F.greatest(F.lit(-FULL), F.least(F.lit(FULL), F.round(c.cast("double") * 8000))) / F.lit(FULL))
    return by.select(F.concat(F.lit("v"), F.col("clip").cast("string"), F.lit(".wav")).alias("name"), F.lit(rate).alias("rate"), s.cast("array<float>").alias("x"))


SAMPLES = """s AS (SELECT vec_id // 64 AS clip, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id, i) - 1 AS i, greatest(-32767, least(32767, round(c * 8000))) / 32768::DOUBLE AS x
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS i FROM embeddings)),
sized AS (SELECT clip, count(*) AS total FROM s GROUP BY clip)"""


def number():
    """The clip's number, from its name."""
    return F.regexp_extract("clip", r"v(\d+)", 1).cast("long").alias("clip")


@query("resampled_clips", f"""WITH {SAMPLES},
m AS (SELECT unnest(range(-30, 31)) AS m),
bessel AS (SELECT m, sum(pow(2.5::DOUBLE * sqrt(1 - (m / 30::DOUBLE) * (m / 30::DOUBLE)) , 2 * k) / (factorial(k::INT)::DOUBLE * factorial(k::INT)::DOUBLE)) AS i0 FROM m, (SELECT unnest(range(0, 18)) AS k) GROUP BY m),
raw AS (SELECT m, CASE WHEN m = 0 THEN 1 ELSE sin(pi() * m / 3) / (pi() * m / 3) END / 3 * i0 AS h FROM bessel),
taps AS (SELECT m, 2 * h / sum(h) OVER () AS h FROM raw),
y AS (SELECT o.clip, k, sum(x * h) AS y FROM (SELECT clip, unnest(range((total * 2 + 2) // 3)) AS k FROM sized) o JOIN taps ON (k * 3 - m) % 2 = 0 JOIN s ON s.clip = o.clip AND s.i = (k * 3 - m) // 2 GROUP BY ALL)
SELECT clip, count(*) AS n, round(sum(y), 3) AS total, round(sum(y * y), 3) AS power, round(max(y), 4) AS high FROM y GROUP BY clip""")
def resampled_clips(spark, sf_dir):
    """Clips of 24 kHz at 16 kHz, in blocks of a thousand samples."""
    own = A.resampled(audio.decoded(written(vector_clips(spark, sf_dir, 24_000)), 16_000, 1000), 16_000)
    each = own.select(number(), F.explode("x").alias("y")).groupBy("clip")
    y = F.col("y").cast("double")
    return each.agg(F.count("*").alias("n"), F.round(F.sum(y), 3).alias("total"), F.round(F.sum(y * y), 3).alias("power"), F.round(F.max(y), 4).alias("high"))


#: Frames of 400 samples every 160, shaped; the whole power by Parseval's theorem.
FRAMED = f"""{SAMPLES},
starts AS (SELECT clip, unnest(range(greatest(0, total - 400) // 160 + 1)) AS frame FROM sized),
shaped AS (SELECT f.clip, frame, i - frame * 160 AS n, x, x * (0.5 - 0.5 * cos(2 * pi() * (i - frame * 160) / 399)) AS v FROM starts f JOIN s ON s.clip = f.clip AND i >= frame * 160 AND i < frame * 160 + 400),
e AS (SELECT clip, frame, 10 * log10((512 * sum(v * v) + pow(sum(v), 2) + pow(sum(v * CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END), 2)) / 2 + 1e-10) AS e FROM shaped GROUP BY ALL),
crossed AS (SELECT clip, frame, sum((a <> b)::INT) / 399::DOUBLE AS zcr FROM (SELECT clip, frame, x < 0 AS a, lead(x < 0) OVER (PARTITION BY clip, frame ORDER BY n) AS b FROM shaped) WHERE b IS NOT NULL GROUP BY ALL)"""


@query("frame_spectra", f"""WITH {FRAMED},
bins AS (SELECT clip, frame, k, pow(sum(v * cos(2 * pi() * k * n / 512)), 2) + pow(sum(v * sin(2 * pi() * k * n / 512)), 2) AS p FROM shaped, (SELECT unnest(range(16)) AS k) GROUP BY ALL),
bands AS (SELECT clip, frame, 10 * log10(sum(p) FILTER (k < 8) + 1e-10) AS low, 10 * log10(sum(p) FILTER (k >= 8) + 1e-10) AS next FROM bins GROUP BY ALL)
SELECT clip, frame, round(e, 4) AS e, round(zcr, 9) AS zcr, round(low - e, 4) AS band0, round(next - e, 4) AS band1 FROM e JOIN crossed USING (clip, frame) JOIN bands USING (clip, frame)""")
def frame_spectra(spark, sf_dir):
    """Energy, sign changes and the two lowest bands of every frame."""
    own = A.frames_of_files(written(vector_clips(spark, sf_dir, A.RATE)))
    return own.select(number(), "frame", F.round("e", 4).alias("e"), F.round("zcr", 9).alias("zcr"), *[F.round(F.get("band", F.lit(i)), 4).alias(f"band{i}") for i in (0, 1)])


@query("frame_features", f"""WITH {FRAMED},
level AS (SELECT clip, count(*) AS n_frames, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90 FROM e GROUP BY clip),
w AS (SELECT clip, gap, gap * 0.021::DOUBLE AS t0, gap * 0.021::DOUBLE + 0.004::DOUBLE + (gap % 4) * 0.03::DOUBLE AS t1 FROM sized, (SELECT unnest(range(9)) AS gap)),
edges AS (SELECT *, greatest(ceil((t0 * 16000 - 200) / 160), 0)::BIGINT AS lo, least(floor((t1 * 16000 - 200) / 160) + 1, n_frames)::BIGINT AS hi, greatest(0, least(round_even(((t0 + t1) / 2 * 16000 - 200) / 160, 0)::BIGINT, n_frames - 1)) AS near FROM w JOIN level USING (clip)),
met AS (SELECT d.clip, gap, t0, t1, p50, p90, e.e, zcr FROM edges d JOIN e ON e.clip = d.clip AND e.frame >= CASE WHEN hi > lo THEN lo ELSE near END AND e.frame < CASE WHEN hi > lo THEN hi ELSE near + 1 END JOIN crossed c ON c.clip = e.clip AND c.frame = e.frame)
SELECT clip, gap, round(any_value(t1 - t0), 4) AS dur, round(avg(e), 3) AS e_mean, round(stddev_pop(e), 3) AS e_std, round(quantile_cont(e, 0.1), 3) AS e_p10, round(avg(e) - any_value(p50), 3) + 0.0 AS e_rel_mean, round(max(e) - any_value(p90), 3) + 0.0 AS e_rel_max,
  round(avg(zcr), 4) AS zcr_mean, round(avg((e < p50 - 25)::INT), 4) AS silence_frac FROM met GROUP BY clip, gap""")
def frame_features(spark, sf_dir):
    """Features of windows over the frames: short windows take the nearest frame."""
    own = kept(A.frames_of_files(written(vector_clips(spark, sf_dir, A.RATE))))
    windows = own.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<long>")).alias("gap"))
    t0 = F.col("gap") * F.lit(0.021)
    made = windows.select("clip", "gap", t0.alias("t0"), (t0 + F.lit(0.004) + (F.col("gap") % 4) * F.lit(0.03)).alias("t1"))
    pick = lambda c, d: (F.round(F.get("features", F.lit(A.NAMES.index(c))).cast("double"), d) + F.lit(0.0)).alias(c)  # noqa: E731 - no negative zero
    return A.window_features(made, own).select(number(), "gap", pick("dur", 4), *[pick(c, 3) for c in ("e_mean", "e_std", "e_p10", "e_rel_mean", "e_rel_max")], pick("zcr_mean", 4), pick("silence_frac", 4))
