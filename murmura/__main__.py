"""Commands: python -m murmura COMMAND ... Tables are Parquet folders; see each command's help.

What needs models (recognition, predicted quality, embeddings) comes as tables: asr (sample_id, tokens, times, duration, text,
error), probs (sample_id, gap, type, prob), pmos and ss (sample_id, value). Audio is WAV files named by sample_id; features of windows are
made of it, or come as a table too (sample_id, gap, features).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from murmura import config
from murmura.operators import acoustics, align, detector, nvpa, report, subset
from murmura.operators import description as D
from murmura.operators import events as E
from murmura.operators import manifest as M
from murmura.operators import ratings as R
from murmura.sources import audio, backends, corpus, manifest, sheets
from murmura.storage import kept


def shown(table, limit=50):
    print(report.table([r.asDict() for r in table.limit(limit).collect()]))


def samples_of(spark, args):
    header, rows = manifest.load(spark, args.manifest)
    return header, M.limited(rows, args.limit) if getattr(args, "limit", None) else rows


def thresholds_of(spark, path):
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(list(json.load(f).items()), "type string, base double")


def tagged(rows):
    return rows.select("sample_id", "speaker", F.col("text").alias("tagged"))


def build(spark, args, _):
    rows = corpus.strict(spark, args.root, args.split)
    files = corpus.files(spark, args.files or args.root)
    refs = manifest.references(spark, args.references) if args.references else None
    made = M.built(rows, args.track, files, references=refs)
    manifest.save(made, args.out, args.track, args.root, args.split)
    shown(M.report(made, files))
    shown(M.languages(made).orderBy(F.desc("n"), "lang"))


def validate(spark, args, _):
    header, rows = samples_of(spark, args)
    problems = M.validated(rows, header["track"])
    shown(problems.groupBy("problem").agg(F.count("*").alias("n")))
    return int(not problems.isEmpty())


def recognised(spark, args, rows):
    """The table of recognitions, or what a backend hears in the samples' files."""
    if args.asr:
        return spark.read.parquet(args.asr)
    if not (args.backend and args.audio):
        raise SystemExit("--asr, or --backend and --audio")
    backend = backends.create("asr", args.backend, **json.loads(args.settings))
    return backends.run(backend, audio.of_samples(spark, args.audio).join(rows.select("sample_id"), "sample_id", "left_semi"), f"{args.out}/asr")


def run(spark, args, own):
    """Word errors, placement and the summary of a manifest against the tables of its recognition and detections."""
    header, rows = samples_of(spark, args)
    asr, limits = recognised(spark, args, rows), thresholds_of(spark, args.thresholds)
    clean = rows.select("sample_id", "speaker", F.array_join("words", " ").alias("text"))
    wer = align.rated(clean, asr.select("sample_id", "text", "error"), ["sample_id"])
    wer.write.mode("overwrite").parquet(f"{args.out}/wer")
    before, after = E.tolerance(own["nvpa"]["tolerance"])
    ready = kept(nvpa.prepared(tagged(rows), asr))
    judged, left = nvpa.outcomes(ready, spark.read.parquet(args.probs), limits, before, after, own["nvpa"]["threshold_scale"])
    judged.write.mode("overwrite").parquet(f"{args.out}/nvpa")
    left.write.mode("overwrite").parquet(f"{args.out}/spurious")
    events = spark.read.parquet(f"{args.out}/nvpa").select("sample_id", "e", "type", "gap", "n_words", "valid")
    check = E.tolerance_check(events, spark.read.parquet(args.probs), limits, own["nvpa"]["threshold_scale"], before, after, own["nvpa"]["shuffle_reps"], own["bootstrap"]["seed"], own["nvpa"]["unreliable_policy"])
    sheets.write_json(check.orderBy("before", "after"), f"{args.out}/tolerance_check")
    return summary(spark, args, own)


def summary(spark, args, own):
    _, rows = samples_of(spark, args)
    wer, judged = spark.read.parquet(f"{args.out}/wer"), E.counted(spark.read.parquet(f"{args.out}/nvpa"), own["nvpa"]["unreliable_policy"])
    parts = rows.select("sample_id", "speaker").join(wer.select("sample_id", "errors", "ref_words"), "sample_id", "left")
    parts = parts.join(judged.groupBy("sample_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("events")), "sample_id", "left")
    for name, column in (("pmos", "pmos"), ("ss", "cosine")):
        path = getattr(args, name, None)
        values = spark.read.parquet(path).select("sample_id", F.col("value").alias(column)) if path else rows.select("sample_id", F.lit(None).cast("double").alias(column))
        parts = parts.join(values, "sample_id", "left")
    human = spark.read.parquet(args.human) if getattr(args, "human", None) else spark.createDataFrame([], "sample_id string, sn double, q double, placement double")
    one = report.summary(parts, human, own["track"], own["human"]["auto_on_subset"])
    sheets.write_json(one, f"{args.out}/summary")
    print(report.lines(one.first().asDict()))
    spread = kept(report.intervals(parts, own["bootstrap"]["n_boot"], own["bootstrap"]["seed"]))
    sheets.write_json(spread.orderBy("metric"), f"{args.out}/intervals")
    shown(spread.orderBy("metric"))


def sweep(spark, args, own):
    _, rows = samples_of(spark, args)
    ready = kept(nvpa.prepared(tagged(rows), spark.read.parquet(args.asr)).where("error IS NULL"))
    events = ready.select("sample_id", "speaker", F.col("n_ref").cast("long").alias("n_words"), F.inline("events")).withColumn("gap", F.col("gap").cast("long"))
    if args.nvpa:  # the judged events know which gaps are usable
        events = spark.read.parquet(args.nvpa).select("sample_id", "speaker", "n_words", "e", "type", "gap", "valid")
    points = E.sweep(events, spark.read.parquet(args.probs), thresholds_of(spark, args.thresholds), args.scales, [E.tolerance(t) for t in args.tolerances], args.reps, own["bootstrap"]["seed"], own["nvpa"]["unreliable_policy"] if args.nvpa else "miss")
    shown(points.where("type IS NULL").orderBy("scale", "before", "after").drop("type"))
    sheets.write_json(points, args.out)


def train(spark, args, own):
    header, rows = samples_of(spark, args)
    if header["split"] == "dev" and not args.allow_dev:
        raise SystemExit("detectors aren't trained on the dev split")
    ready = kept(nvpa.prepared(tagged(rows), spark.read.parquet(args.asr)))
    if args.audio:
        windows = detector.timed_windows(ready).where("valid")
        features = kept(acoustics.of_samples(windows, audio.of_samples(spark, args.audio)))
        features.write.mode("overwrite").parquet(f"{args.out}/features")
    else:
        features = spark.read.parquet(args.features)
    windows, counts = detector.training_set(ready, features, args.types)
    windows.write.mode("overwrite").parquet(f"{args.out}/windows")
    found = detector.trained(spark.read.parquet(f"{args.out}/windows"), args.types, args.folds, own["bootstrap"]["seed"], maxIter=args.iterations)
    detector.save(found, args.out, spark)
    shown(counts)
    for t, d in found.items():
        print(report.lines({"type": t} | {k: v for k, v in d.items() if k != "model"}))


def choose(spark, args, own):
    _, rows = samples_of(spark, args)
    h = own["human"]
    pool = rows.select("sample_id", "speaker", F.transform("events", lambda e: e["type"]).alias("types"), F.lit(None).cast("double").alias("seconds"), F.size("words").alias("n_words"))
    chosen = subset.selected(pool, h["subset_size"], h["seed"], h["rare_type_share"], h["max_rare_fraction"])
    chosen.write.mode("overwrite").parquet(f"{args.out}/subset")
    shown(subset.composition(pool, chosen))
    sheets.write_package(subset.package(pool, spark.read.parquet(f"{args.out}/subset"), h["n_gt_anchors"], h["n_degraded_anchors"], h["seed"]), f"{args.out}/package")


def export(spark, args, own):
    _, rows = samples_of(spark, args)
    h = own["human"]
    generated, truth = (audio.of_samples(spark, x) for x in (args.audio, args.truth))
    shown(sheets.export(rows.select("sample_id", "speaker", "text"), spark.read.parquet(args.subset), generated, truth, args.out, h["n_gt_anchors"], h["n_degraded_anchors"], h["degrade_snr_db"], h["seed"]))


def ratings(spark, args, own):
    h, typed, key = own["human"], sheets.read(spark, args.sheets), sheets.read_key(spark, args.package)
    rows = R.cleaned(typed)
    raters = R.anchors(rows, key, h["anchor_gt_min"], h["anchor_gap_min"], h["exclude_flagged"])
    R.sample_means(R.of_accepted(rows, key, raters)).write.mode("overwrite").parquet(args.out)
    shown(raters.withColumn("reasons", F.array_join("reasons", "; ")))
    shown(R.problems(typed).select("rater", "item", "field", "typed").unionByName(R.unknown(rows, key).select("rater", "item", F.lit("item").alias("field"), F.col("item").alias("typed"))), 20)


def describe(spark, args, _):
    """The corpus as tables: utterances.csv, speakers.csv and the summary as JSON; the rest is printed."""
    found = [corpus.scan(spark, args.root, s) for s in args.splits]
    rows, problems = found[0]
    for more, bad in found[1:]:
        rows, problems = rows.unionByName(more), problems.unionByName(bad)
    infos = None
    if not args.no_audio:
        name = args.root.rstrip("/").rsplit("/", 1)[-1]
        files = audio.files(spark, [f"{args.root}/{s}" for s in args.splits])
        infos = kept(audio.probed(files.withColumn("clip", F.regexp_extract("clip", f".*?/{name}/(.*)$", 1))))
    own = kept(D.analysed(rows, infos, args.letters))
    tags = D.tags(own, args.tags)
    for title, table in (("overview", D.overview(own)), ("tags", tags), ("measures", D.measures(own)), ("quality", D.quality(own)), ("counters", D.counters(own)), ("repeated", D.repeated(own)), ("formats", D.formats(infos) if infos is not None else None), ("problems", problems.limit(20))):
        if table is not None:
            print(f"\n{title}")
            shown(table)
    sheets.write_csv(D.listed(own), f"{args.out}/utterances")
    sheets.write_csv(D.speakers(own, args.splits, args.tags).orderBy("speaker"), f"{args.out}/speakers")
    sheets.write_json(D.overview(own), f"{args.out}/summary")
    sheets.write_json(D.measures(own), f"{args.out}/measures")


def main(argv=None, spark=None):
    parser = argparse.ArgumentParser(prog="murmura", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name, fn, *options, **more):
        own = commands.add_parser(name)
        own.set_defaults(fn=fn)
        for o in options:
            own.add_argument(f"--{o}", required=True)
        for o, kinds in more.items():
            own.add_argument(f"--{o.replace('_', '-')}", **kinds)

    n = {"limit": {"type": int}}
    add("manifest", build, "root", "split", "out", track={"default": "A"}, references={}, files={})
    add("validate", validate, "manifest", **n)
    add("run", run, "manifest", "probs", "thresholds", "out", asr={}, backend={}, audio={}, settings={"default": "{}"}, pmos={}, ss={}, human={}, **n)
    add("summary", summary, "manifest", "out", pmos={}, ss={}, human={}, **n)
    add("nvpa-sweep", sweep, "manifest", "asr", "probs", "thresholds", "out", nvpa={}, scales={"type": float, "nargs": "+", "default": [0.5, 0.75, 1.0, 1.25]}, tolerances={"nargs": "+", "default": ["0", "1", "2", "3"]}, reps={"type": int, "default": 20})
    add("train-detector", train, "manifest", "asr", "out", features={}, audio={}, types={"nargs": "+", "required": True}, folds={"type": int, "default": 5}, iterations={"type": int, "default": 200}, allow_dev={"action": "store_true"})
    add("human-subset", choose, "manifest", "out", **n)
    add("human-export", export, "manifest", "subset", "audio", "truth", "out", **n)
    add("corpus-report", describe, "root", "out", splits={"nargs": "+", "default": ["train", "dev"]}, tags={"nargs": "+", "default": ["laughter", "breathing", "sniff", "throatclearing"]}, letters={"default": "vi"}, no_audio={"action": "store_true"})
    add("human-import", ratings, "sheets", "package", "out")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("murmura").getOrCreate()
    return args.fn(spark, args, config.load(args.config)) or 0


if __name__ == "__main__":
    sys.exit(main())
