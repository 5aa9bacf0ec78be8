"""Corpus description and checks: splits, pivots, leakage, manifests, references, subsets, packages, fingerprints, reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import description as D
from murmura.operators import manifest as M
from murmura.operators import subset as S
from murmura.plans import fixtures as X
from murmura.plans import read, spread
from murmura.registry import query

#: Three documents of four are for training; a split's texts are those of the test tables, their audio is made up.
SPLIT = "CASE WHEN doc_id % 4 = 3 THEN 'dev' ELSE 'train' END"


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("split", F.expr(SPLIT))


#: Every ninth text is torn at its end: the bracket that is left stays a word.
TORN = "(CASE WHEN doc_id % 9 = 0 AND text IS NOT NULL THEN 1 ELSE 0 END)"
OVERVIEW = X.GOLD + f""", texts AS (SELECT doc_id AS sample_id, {SPLIT} AS split, source, lang, n_chars / 15::DOUBLE AS seconds, {TORN} AS torn FROM documents),
per_text AS (SELECT t.*, coalesce(w.words, 0) + torn AS words, coalesce(g.events, 0) AS events, coalesce(g.types, 0) AS types FROM texts t
  LEFT JOIN (SELECT sample_id, count(*) FILTER (type IS NULL) AS words FROM parsed GROUP BY sample_id) w USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS events, count(DISTINCT type) AS types FROM gold GROUP BY sample_id) g USING (sample_id))
"""


def described(spark, sf_dir, language=None):
    """The documents as a corpus, described: fifteen characters last a second, some have further keys."""
    docs = spread(documents(spark, sf_dir))
    torn = F.concat(X.tagged(F.col("text")), F.when(F.col("doc_id") % 9 == 0, " [").otherwise(""))
    more = F.concat_ws("|", F.when(F.col("doc_id") % 5 == 0, "note"), F.when(F.col("doc_id") % 7 == 0, "take"))
    name = F.col("doc_id").cast("string")
    rows = docs.select("split", F.col("source").alias("speaker"), name.alias("audio"), torn.alias("tagged"), "lang", more.alias("more"), "n_chars")
    return D.analysed(rows, None, language).withColumn("seconds", F.col("n_chars") / 15.0)


@query("corpus_overview", f"WITH {OVERVIEW} SELECT split, count(DISTINCT source) AS speakers, count(*) AS utterances, sum(words)::BIGINT AS words, sum(events)::BIGINT AS events, count(*) FILTER (events = 0) AS without_events, round(sum(seconds) / 3600, 6) AS hours FROM per_text GROUP BY split")
def corpus_overview(spark, sf_dir):
    return D.overview(described(spark, sf_dir)).withColumn("hours", F.round("hours", 6))


@query("speaker_pivot", f"WITH {OVERVIEW}, kinds AS (SELECT source AS speaker, " + ", ".join(f"count(*) FILTER (type = '{t}') AS train_{t}" for t in X.THRESHOLDS) + " FROM gold JOIN texts USING (sample_id) WHERE split = 'train' GROUP BY source) SELECT source AS speaker, count(*) FILTER (split = 'train') AS train_n, coalesce(round(sum(seconds) FILTER (split = 'train') / 60, 6), 0) AS train_minutes, count(*) FILTER (split = 'dev') AS dev_n, coalesce(round(sum(seconds) FILTER (split = 'dev') / 60, 6), 0) AS dev_minutes, "
  + ", ".join(f"coalesce(any_value(train_{t}), 0) AS train_{t}" for t in X.THRESHOLDS) + " FROM texts LEFT JOIN kinds ON kinds.speaker = source GROUP BY source")
def speaker_pivot(spark, sf_dir):
    own = D.speakers(described(spark, sf_dir), ["train", "dev"], list(X.THRESHOLDS))
    return own.withColumns({c: F.round(c, 6) for c in ("train_minutes", "dev_minutes")})


@query("tag_pivot", f"WITH {OVERVIEW}, each_event AS (SELECT g.type, t.split, g.sample_id, g.gap, g.n_words + torn AS n_words FROM gold g JOIN texts t USING (sample_id)), total AS (SELECT split, count(*) AS texts, sum(words) AS words, sum(seconds) / 60 AS minutes FROM per_text GROUP BY split) " + """
SELECT type, split, count(*) AS n, count(DISTINCT sample_id) AS texts, round(100::DOUBLE * count(DISTINCT sample_id) / any_value(total.texts), 6) AS percent, round(100::DOUBLE * count(*) / any_value(words), 6) AS per_100_words, round(count(*) / any_value(minutes), 6) AS per_minute,
  count(*) FILTER (gap = 0) AS at_start, count(*) FILTER (gap > 0 AND gap < n_words) AS at_mid, count(*) FILTER (gap > 0 AND gap >= n_words) AS at_end, NOT list_contains(['breathing', 'laughter'], type) AS unlisted FROM each_event JOIN total USING (split) GROUP BY type, split""")
def tag_pivot(spark, sf_dir):
    """Tags by split, the listed ones first."""
    return D.tags(described(spark, sf_dir), ["breathing", "laughter"]).withColumns({c: F.round(c, 6) for c in ("percent", "per_100_words", "per_minute")})


@query("length_rates", f"WITH {OVERVIEW}, long AS (SELECT split, unnest(['words', 'seconds', 'words_per_second', 'events_per_second']) AS measure, unnest([words::DOUBLE, seconds, words / nullif(seconds, 0), events / nullif(seconds, 0)]) AS x FROM per_text) SELECT split, measure, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS p{round(100 * q)}" for q in (0.05, 0.5, 0.95)) + " FROM long WHERE x IS NOT NULL GROUP BY ALL")
def length_rates(spark, sf_dir):
    """Lengths and speaking rates by split."""
    table = D.measures(described(spark, sf_dir), (0.05, 0.5, 0.95))
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "std", "low", "high", "p5", "p50", "p95")})


@query("quality_by_split", f"WITH {OVERVIEW}, t AS (SELECT doc_id AS sample_id, {SPLIT} AS split, coalesce({X.TAGGED} || CASE WHEN doc_id % 9 = 0 THEN ' [' ELSE '' END, '') AS t FROM documents) SELECT split, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p in T.FLAGS.items() if k != "wide")
  + f", count(*) FILTER (t <> nfc_normalize(t)) AS decomposed, count(*) FILTER (len(list_filter(regexp_extract_all(lower(regexp_replace(t, '\\[[^\\[\\]]*\\]', ' ', 'g')), '\\p{{L}}'), lambda c: NOT contains('{T.alphabet('de')}', c))) > 0) AS foreign, count(*) FILTER ((SELECT words FROM per_text p WHERE p.sample_id = t.sample_id LIMIT 1) = 0) AS empty FROM t GROUP BY split")
def quality_by_split(spark, sf_dir):
    """Flags by split, letters that aren't German ones, and texts without words."""
    return D.quality(described(spark, sf_dir, "de"))


@query("metadata_counters", f"WITH d AS (SELECT {SPLIT} AS split, lang, doc_id FROM documents) SELECT split, 'language' AS what, lang AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT split, 'key', 'note', count(*) FROM d WHERE doc_id % 5 = 0 GROUP BY ALL UNION ALL SELECT split, 'key', 'take', count(*) FROM d WHERE doc_id % 7 = 0 GROUP BY ALL")
def metadata_counters(spark, sf_dir):
    """Languages and further keys of the metadata by split."""
    return D.counters(described(spark, sf_dir))


@query("speaker_sets", f"WITH d AS (SELECT DISTINCT source || coalesce(lang, '') || doc_id % 7 AS speaker, {SPLIT} AS split FROM documents) SELECT 'train' AS side, count(*) AS n FROM (SELECT speaker FROM d WHERE split = 'train' EXCEPT SELECT speaker FROM d WHERE split = 'dev') UNION ALL SELECT 'dev', count(*) FROM (SELECT speaker FROM d WHERE split = 'dev' EXCEPT SELECT speaker FROM d WHERE split = 'train')")
def speaker_sets(spark, sf_dir):
    """Speakers that only one of the splits has."""
    own = documents(spark, sf_dir).select(F.concat("source", F.coalesce("lang", F.lit("")), (F.col("doc_id") % 7).cast("string")).alias("speaker"), "split")
    train, dev = (own.where(F.col("split") == s).select("speaker") for s in ("train", "dev"))
    only = lambda a, b, side: a.subtract(b).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return only(train, dev, "train").union(only(dev, train, "dev"))


@query("leakage", f"WITH d AS (SELECT text, {SPLIT} AS split FROM documents) SELECT count(*) AS n FROM d WHERE split = 'dev' AND text IN (SELECT text FROM d WHERE split = 'train')")
def leakage(spark, sf_dir):
    """Texts of the dev split that the training split has too, compared by digest."""
    own = documents(spark, sf_dir).select("split", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return own.where("split = 'dev'").join(own.where("split = 'train'").select("h"), "h", "left_semi").agg(F.count("*").alias("n"))


@query("manifest_problems", "SELECT 'duplicate_text' AS problem, sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE len(text) <> n_chars UNION ALL SELECT 'duplicate_id', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def manifest_problems(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    extra = lambda by: docs.where(F.expr(by).isNotNull()).groupBy(F.expr(by)).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    length = docs.where(F.length("text") != F.col("n_chars")).agg(F.count("*").alias("n"))
    named = [("duplicate_text", extra("sha2(cast(text AS binary), 256)")), ("wrong_length", length), ("duplicate_id", extra("doc_id"))]
    parts = [t.select(F.lit(k).alias("problem"), "n") for k, t in named]
    return parts[0].union(parts[1]).union(parts[2])


#: Utterances of a made-up corpus, the files that are there, and references of track B.
UTTERANCES = f"""
utt AS (SELECT {SPLIT} AS split, source AS speaker, 'audio/' || source || '/' || (doc_id - doc_id % 50 % 2) || '.wav' AS audio, {X.TAGGED} || CASE WHEN doc_id % 9 = 0 THEN ' [' ELSE '' END AS tagged, lang, doc_id, source || '_' || (doc_id - doc_id % 50 % 2) AS sample_id FROM documents),
files AS (SELECT DISTINCT audio AS path FROM utt WHERE doc_id % 25 > 1 UNION SELECT 'out/' || source || '_' || doc_id || '.flac' FROM documents WHERE doc_id % 3 <> 0 UNION SELECT 'out/' || source || '_' || doc_id || '.wav' FROM documents WHERE doc_id % 4 = 0)
"""


def utterances(spark, sf_dir):
    name = (F.col("doc_id") - F.col("doc_id") % 50 % 2).cast("string")
    torn = F.concat(X.tagged(F.col("text")), F.when(F.col("doc_id") % 9 == 0, " [").otherwise(""))
    return documents(spark, sf_dir).select("split", F.col("source").alias("speaker"), F.concat(F.lit("audio/"), "source", F.lit("/"), name, F.lit(".wav")).alias("audio"), torn.alias("tagged"), "lang", "doc_id")


def files(spark, sf_dir):
    docs, own = read(spark, sf_dir, "documents"), utterances(spark, sf_dir)
    out = lambda where, ext: docs.where(where).select(F.concat(F.lit("out/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(ext)).alias("path"))
    return own.where("doc_id % 25 > 1").select(F.col("audio").alias("path")).union(out("doc_id % 3 <> 0", ".flac")).union(out("doc_id % 4 = 0", ".wav")).distinct()


REFS = UTTERANCES + """,
clips AS (SELECT speaker, audio, row_number() OVER (PARTITION BY speaker ORDER BY audio) AS k FROM utt WHERE split = 'train'), few AS (SELECT speaker, list(audio ORDER BY audio) AS clips FROM clips WHERE k <= 4 GROUP BY speaker),
made AS (SELECT sample_id, speaker, lang, tagged, audio, coalesce(list_filter(clips, lambda c: c <> audio)[1:3], []) AS refs,
    CASE WHEN EXISTS (SELECT 1 FROM files WHERE path = 'out/' || sample_id || '.wav') THEN 'out/' || sample_id || '.wav' WHEN EXISTS (SELECT 1 FROM files WHERE path = 'out/' || sample_id || '.flac') THEN 'out/' || sample_id || '.flac' END AS generated,
    regexp_matches(regexp_replace(tagged, '\\[[^\\[\\]]*\\]', ' ', 'g'), '[\\[\\]]') AS torn
  FROM utt LEFT JOIN few USING (speaker) WHERE split = 'dev')
"""


def built(spark, sf_dir):
    own = utterances(spark, sf_dir)
    return M.built(own.where("split = 'dev'"), "A", files(spark, sf_dir), own.where("split = 'train'"), most=3)


@query("reference_clips_topk", f"WITH {REFS} SELECT sample_id, array_to_string(refs, ',') AS refs, generated, count(*) AS n FROM made GROUP BY ALL")
def reference_clips_topk(spark, sf_dir):
    """Each sample's first three references of its speaker, never itself, and its generated file."""
    return built(spark, sf_dir).groupBy("sample_id", F.array_join("refs", ",").alias("refs"), "generated").agg(F.count("*").alias("n"))


@query("build_report", f"WITH {REFS} SELECT count(*) AS samples, count(DISTINCT speaker) AS speakers, count(*) FILTER (NOT EXISTS (SELECT 1 FROM files WHERE path = audio)) AS missing_ground_truth, count(*) FILTER (generated IS NULL) AS missing_generated, count(DISTINCT speaker) FILTER (len(refs) = 0) AS speakers_without_references, count(*) FILTER (torn) AS errors FROM made")
def build_report(spark, sf_dir):
    return M.report(built(spark, sf_dir), files(spark, sf_dir))


@query("build_languages", f"WITH {REFS} SELECT lang, count(*) AS n FROM made GROUP BY lang")
def build_languages(spark, sf_dir):
    """Samples of the manifest by language."""
    return M.languages(built(spark, sf_dir))


@query("missing_inputs", f"WITH {REFS}, one AS (SELECT sample_id, any_value(generated) AS generated, any_value(audio) AS audio, flatten(list(refs)) AS refs FROM made GROUP BY sample_id), " + """
bad AS (SELECT DISTINCT sample_id FROM (SELECT sample_id, unnest(refs) AS r FROM one) WHERE NOT EXISTS (SELECT 1 FROM files WHERE path = r)),
judged AS (SELECT sample_id, CASE WHEN generated IS NULL OR NOT EXISTS (SELECT 1 FROM files WHERE path = generated) THEN 'missing_generated_audio' WHEN len(refs) = 0 OR EXISTS (SELECT 1 FROM bad WHERE bad.sample_id = one.sample_id) THEN 'missing_reference_audio'
  WHEN NOT EXISTS (SELECT 1 FROM files WHERE path = audio) THEN 'missing_ground_truth_audio' END AS missing FROM one) SELECT coalesce(missing, 'none') AS missing, count(*) AS n FROM judged GROUP BY ALL""")
def missing_inputs(spark, sf_dir):
    found = M.missing_inputs(built(spark, sf_dir), files(spark, sf_dir), ground_truth=True)
    return found.groupBy(F.coalesce("missing", F.lit("none")).alias("missing")).agg(F.count("*").alias("n"))


@query("manifest_validate", f"WITH {REFS} SELECT problem, count(*) AS n FROM (SELECT 'text: unbalanced bracket' AS problem FROM made WHERE torn UNION ALL SELECT 'words differ from the text' FROM made WHERE NOT torn AND speaker = 'src2' UNION ALL SELECT 'no references' FROM made WHERE len(refs) = 0 UNION ALL SELECT 'duplicate id' FROM (SELECT sample_id FROM made GROUP BY sample_id HAVING count(*) > 1)) GROUP BY problem")
def manifest_validate(spark, sf_dir):
    """Problems of a manifest whose words were changed for one speaker, as track B has them."""
    changed = built(spark, sf_dir).withColumn("words", F.when(F.col("speaker") == "src2", F.concat("words", F.array(F.lit("more")))).otherwise(F.col("words")))
    return M.validated(changed, "B").groupBy("problem").agg(F.count("*").alias("n"))


@query("unlisted_files", f"WITH {UTTERANCES} SELECT count(*) AS n FROM files WHERE NOT EXISTS (SELECT 1 FROM utt WHERE audio = path AND split = 'train')")
def unlisted_files(spark, sf_dir):
    """Files that no training utterance names."""
    listed = utterances(spark, sf_dir).where("split = 'train'").select(F.col("audio").alias("path"))
    return files(spark, sf_dir).join(listed, "path", "left_anti").agg(F.count("*").alias("n"))


@query("expected_outputs", f"WITH {UTTERANCES}, present AS (SELECT DISTINCT regexp_extract(path, '([^/]+)\\.[a-z]+$', 1) AS id FROM files WHERE path LIKE 'out/%'), expected AS (SELECT DISTINCT sample_id AS id FROM utt) SELECT 'missing' AS side, count(*) AS n FROM (SELECT id FROM expected EXCEPT SELECT id FROM present) UNION ALL SELECT 'extra', count(*) FROM (SELECT id FROM present EXCEPT SELECT id FROM expected)")
def expected_outputs(spark, sf_dir):
    """Samples without an output, and outputs without a sample."""
    present = files(spark, sf_dir).where("path LIKE 'out/%'").select(M.stem(F.col("path")).alias("id"))
    expected = utterances(spark, sf_dir).select(M.sample_id(F.col("speaker"), F.col("audio")).alias("id"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(expected.subtract(present), "missing").union(count(present.subtract(expected), "extra"))


@query("reference_clips", "SELECT label, array_to_string(list(vec_id ORDER BY vec_id)[1:5], ',') AS clips FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label")
def reference_clips(spark, sf_dir):
    """The first five references of each speaker; row numbers stop early, so a hot speaker is no hot list."""
    order = Window.partitionBy("label").orderBy("vec_id")
    first = read(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select("label", "vec_id", F.row_number().over(order).alias("k")).where("k <= 5")
    return first.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("clips"))


@query("subset_round_robin", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id)) AS k FROM documents)
SELECT doc_id, source FROM r ORDER BY k, md5('7|' || source), doc_id LIMIT 100""")
def subset_round_robin(spark, sf_dir):
    """A hundred samples, one of each speaker in turn, in an order drawn by hash."""
    pool = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker"))
    return S.in_turn(pool, 100, 7).select(F.col("sample_id").alias("doc_id"), F.col("speaker").alias("source"))


def conversations(spark, sf_dir):
    """Conversations as samples: their roles are the types of events, their first turn's remainder the speaker."""
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("types"), F.sum(F.length("text")).alias("n"))
    return by.select(F.col("conv_id").alias("sample_id"), (F.col("conv_id") % 13).cast("string").alias("speaker"), "types", F.when(F.col("conv_id") % 3 != 0, F.col("n") / 15.0).alias("seconds"), F.floor(F.col("n") / 6).alias("n_words"))


@query("rare_types", "SELECT role, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share, count(*)::DOUBLE / sum(count(*)) OVER () <= 0.05 AS rare FROM conversations GROUP BY role")
def rare_types(spark, sf_dir):
    return S.type_shares(conversations(spark, sf_dir)).select(F.col("type").alias("role"), "n", F.round("share", 9).alias("share"), (F.col("share") <= 0.05).alias("rare"))


SELECTED = """WITH RECURSIVE conv AS (SELECT conv_id AS id, list(role) AS types, sum(length(text))::DOUBLE AS n FROM conversations GROUP BY conv_id),
samples AS (SELECT id, (id % 13)::VARCHAR AS speaker, types, CASE WHEN id % 3 <> 0 THEN n / 15 END AS seconds, floor(n / 6) AS n_words FROM conv),
kinds AS (SELECT role, row_number() OVER (ORDER BY n, role) AS k FROM (SELECT role, count(*) AS n, sum(count(*)) OVER () AS every FROM conversations GROUP BY role) WHERE n::DOUBLE / every <= 0.05),
rare AS (SELECT id, types, row_number() OVER (ORDER BY n DESC, md5('0|' || id), id) AS place FROM samples JOIN (SELECT conv_id AS id, count(*) AS n FROM conversations WHERE role IN (SELECT role FROM kinds) GROUP BY conv_id) USING (id)),
offers AS (SELECT k, list(place ORDER BY place) AS places FROM kinds JOIN rare ON list_contains(types, role) GROUP BY k),
picks AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT picks.k + 1, CASE WHEN len(taken) >= 20 THEN taken ELSE list_concat(taken, list_filter(places, lambda x: NOT list_contains(taken, x))[1:1]) END FROM picks JOIN offers ON offers.k = picks.k + 1),
covered AS (SELECT taken FROM picks ORDER BY k DESC LIMIT 1),
filled AS (SELECT id FROM (SELECT id, place, list_contains(taken, place) AS first, row_number() OVER (ORDER BY NOT list_contains(taken, place), place) AS turn FROM rare, covered) WHERE turn <= 20),
many AS (SELECT speaker, count(*) AS n FROM samples GROUP BY speaker),
pool AS (SELECT id, speaker, CASE WHEN m.n >= 20 THEN 'head' ELSE 'tail' END || '_' || CASE WHEN coalesce(seconds >= 15, n_words >= 50) THEN 'long' ELSE 'short' END AS part FROM samples JOIN many m USING (speaker) WHERE id NOT IN (SELECT id FROM filled)),
sizes AS (SELECT part, count(*) AS size FROM pool GROUP BY part),
rounds AS (
  SELECT 0 AS r, 40 - (SELECT count(*) FROM filled) AS total, list({'part': part, 'size': size, 'given': 0::BIGINT, 'share': 0::DOUBLE} ORDER BY part) AS s FROM sizes
  UNION ALL
  SELECT r + 1, total, CASE WHEN whole > 0 THEN list_transform(s, lambda x: {'part': x.part, 'size': x.size, 'given': x.given + least(floor(x.share)::BIGINT, x.size - x.given), 'share': 0::DOUBLE})
    ELSE list_transform(s, lambda x: {'part': x.part, 'size': x.size, 'given': x.given + list_contains(first, x.part)::BIGINT, 'share': 0::DOUBLE}) END
  FROM (SELECT *, list_sum(list_transform(s, lambda x: least(floor(x.share)::BIGINT, x.size - x.given))) AS whole, list_transform(list_sort(list_transform(list_filter(s, lambda x: x.share > 0), lambda x: {'a': -x.share, 'b': x.part})), lambda x: x.b)[1:greatest(to_give, 0)] AS first
    FROM (SELECT r, total, to_give, list_transform(s, lambda x: {'part': x.part, 'size': x.size, 'given': x.given, 'share': CASE WHEN roots > 0 THEN to_give * sqrt((x.size - x.given)::DOUBLE) / roots ELSE 0 END}) AS s
      FROM (SELECT *, (least(total, list_sum(list_transform(s, lambda x: x.size))) - list_sum(list_transform(s, lambda x: x.given)))::BIGINT AS to_give, list_sum(list_transform(s, lambda x: sqrt((x.size - x.given)::DOUBLE))) AS roots FROM rounds WHERE r < 10)))),
given AS (SELECT unnest(s) AS x FROM (SELECT s FROM rounds ORDER BY r DESC LIMIT 1)),
turns AS (SELECT *, row_number() OVER (PARTITION BY part, speaker ORDER BY md5('0|' || id)) AS k FROM pool),
placed AS (SELECT id, speaker, part, row_number() OVER (PARTITION BY part ORDER BY k, md5('0|' || speaker), id) AS place FROM turns)
SELECT id AS sample_id, speaker, 'rare' AS part FROM samples WHERE id IN (SELECT id FROM filled) UNION ALL SELECT id, speaker, part FROM placed JOIN given ON x.part = placed.part WHERE place <= x.given"""


@query("subset_select", SELECTED)
def subset_select(spark, sf_dir):
    """Forty conversations, rare roles first, the rest by quotas of strata."""
    return S.selected(conversations(spark, sf_dir), 40, 0)


ITEMS = """chosen AS (SELECT doc_id AS sample_id, source AS speaker FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id)) AS k FROM documents) ORDER BY k, md5('7|' || source), doc_id LIMIT 30),
pool AS (SELECT doc_id AS sample_id, source AS speaker FROM documents WHERE doc_id NOT IN (SELECT sample_id FROM chosen)),
every AS (SELECT *, 'model' AS kind FROM chosen UNION ALL SELECT *, 'anchor_gt' FROM (SELECT * FROM pool ORDER BY md5('7|' || sample_id), sample_id LIMIT 5) UNION ALL SELECT *, 'anchor_degraded' FROM (SELECT * FROM pool ORDER BY md5('8|' || sample_id), sample_id LIMIT 5))"""


@query("package_items", f"WITH {ITEMS} SELECT 'item_' || lpad((row_number() OVER (ORDER BY md5('7|' || kind || '|' || sample_id), kind, sample_id))::VARCHAR, 4, '0') AS item, kind, sample_id, speaker FROM every")
def package_items(spark, sf_dir):
    """Items to rate: thirty samples and ten anchors from outside them, numbered in an order drawn by hash."""
    pool = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker"))
    return S.package(pool, S.in_turn(pool, 30, 7), seed=7)


@query("fingerprint", """WITH h AS (SELECT source, sha256(to_json({'doc_id': doc_id, 'n_chars': n_chars, 'h': sha256(coalesce(text, ''))})) AS h FROM documents)
SELECT source, count(*) AS n, sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 12))::BIGINT) || '|' || sum(('0x' || substr(h, 13, 12))::BIGINT)) AS digest FROM h GROUP BY source""")
def fingerprint(spark, sf_dir):
    """Digest of each source's rows, whatever their order."""
    own = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return M.fingerprint(own, ["doc_id", "n_chars", "h"], ["source"])


#: Results of four metrics, made of the tables: each lacks some samples.
@query("per_sample_report", """WITH wer AS (SELECT doc_id, n_chars % 53 / 52::DOUBLE AS wer FROM documents WHERE doc_id % 5 <> 0), pmos AS (SELECT doc_id, 1 + 4 * (n_chars % 401 / 400::DOUBLE) AS pmos FROM documents WHERE doc_id % 7 <> 0), ss AS (SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS ss FROM embeddings)
SELECT d.doc_id, d.source, round(wer, 9) AS wer, round(pmos, 9) AS pmos, round(ss, 9) AS ss, l.quality, (wer IS NULL)::INT + (pmos IS NULL)::INT + (ss IS NULL)::INT + (l.quality IS NULL)::INT AS missing FROM documents d LEFT JOIN wer USING (doc_id) LEFT JOIN pmos USING (doc_id) LEFT JOIN ss USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def per_sample_report(spark, sf_dir):
    """Each metric's results beside the samples, and how many a sample lacks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    wer = docs.where("doc_id % 5 <> 0").select("doc_id", F.round(F.col("n_chars") % 53 / 52, 9).alias("wer"))
    pmos = docs.where("doc_id % 7 <> 0").select("doc_id", F.round(1 + 4 * (F.col("n_chars") % 401 / 400), 9).alias("pmos"))
    ss = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 9).alias("ss"))
    wide = docs.drop("n_chars")
    for part in (wer, pmos, ss, read(spark, sf_dir, "labels").select("doc_id", "quality")):
        wide = wide.join(part, "doc_id", "left")
    return wide.withColumn("missing", sum((F.col(c).isNull().cast("int") for c in ("pmos", "ss", "quality")), F.col("wer").isNull().cast("int")))


@query("speaker_report", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(avg(quality), 9) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 5")
def speaker_report(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg("quality"), 9).alias("quality")).where("n >= 5")
