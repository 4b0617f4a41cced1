"""Command line: match, segment and evaluate."""

from __future__ import annotations

import argparse
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="match recalls to a story")
    m.add_argument("story")
    m.add_argument("recalls")
    s = sub.add_parser("segment", help="divide the text files of a folder into lines, sentences, or as a model says")
    s.add_argument("folder")
    s.add_argument("output")
    s.add_argument("--by", choices=["lines", "sentences", "model"], default="sentences")
    e = sub.add_parser("evaluate", help="score a backend on a benchmark story")
    e.add_argument("root")
    e.add_argument("testset")
    e.add_argument("--repeats", type=int, default=5, help="repeats of each recall in repeat mode")
    e.add_argument("--repeat-reliability", action="store_true", help="match each recall several times and compare the results")
    e.add_argument("--output", default="data/eval")
    e.add_argument("--dry-run", action="store_true")
    for x in (m, e, s):
        x.add_argument("--matcher", default="lexical")
        x.add_argument("--model")
        x.add_argument("--prompt")
        x.add_argument("--window", type=int, default=5)
        x.add_argument("--max-retries", type=int)
    m.add_argument("--output", help="folder of the result; by default beside the recalls, never among a folder's recalls")
    m.add_argument("--story-name", help="instead of the story's file name")
    m.add_argument("--story-segmentation", help="instead of the method that the story's file names")
    m.add_argument("--recall-segmentation", help="instead of the method that the recalls name")
    m.add_argument("--batch", type=int, default=500, help="subjects that are matched together; what is finished is not asked again after a stop")
    m.add_argument("--overwrite", action="store_true")
    m.add_argument("--dry-run", action="store_true")
    return p


def _backend(args):
    from tessera.plans.backends import get_backend

    given = {"model": args.model, "prompt": args.prompt, "window": args.window, "max_retries": args.max_retries}
    return get_backend(args.matcher, **{k: v for k, v in given.items() if v is not None})


def _segment(args, spark: SparkSession) -> None:
    from tessera.functions import text
    from tessera.operators.segments import explode_segments, sentence_segments
    from tessera.plans.segmentation import segment_texts
    from tessera.sources.segments import list_files, whole_files
    from tessera.sources.sinks import write_segment_csv

    files = whole_files(spark, [f for f in list_files(spark, args.folder) if f.endswith(".txt")]).withColumnRenamed("name", "stem")
    if args.by == "sentences":
        rows = sentence_segments(files, ["stem"])
    elif args.by == "lines":
        rows = explode_segments(files, ["stem"], text.lines("text"))
    else:
        rows = explode_segments(segment_texts(files, ["stem"], _backend(args)), ["stem"], F.col("segments"))
    write_segment_csv(rows, args.output)


def _match(args, spark: SparkSession):
    from tessera.plans.matching import estimate
    from tessera.plans.resumable import finished, interruptible, match_in_batches
    from tessera.sources import segments as src
    from tessera.sources.sinks import exists, progress_of, remove, result_path, write_matches

    backend = _backend(args)
    story, recall = src.read_story(spark, args.story), src.read_recalls(spark, args.recalls)
    found = story.select("story_name", "story_seg_method").first()
    name, method = args.story_name or found["story_name"], args.story_segmentation or found["story_seg_method"]
    recall_method = args.recall_segmentation or recall.select("recall_seg_method").first()[0]
    story, own = story.withColumn("story_name", F.lit(name)), recall.withColumn("story_name", F.lit(name))
    if args.dry_run:
        return estimate(story, own, backend).first().asDict()
    path = result_path(spark, args.output or src.parent_folder(spark, args.recalls), args.matcher, recall_method, method, args.overwrite)
    checkpoint = f"{path.removesuffix('.json')}.checkpoint.json"
    names = (args.matcher, name, method, recall_method, args.model)
    total = recall.select("sub_id").distinct().count()
    ledger = f"{path.removesuffix('.json')}.ledger"
    try:
        with interruptible(spark):
            write_matches(match_in_batches(story, own, backend, ledger, args.batch), path, *names)
    except KeyboardInterrupt:
        done = finished(spark, ledger).select("sub_id", "recall_idx", "story_idxs")
        ids = [r["sub_id"] for r in done.select("sub_id").distinct().collect()]  # names of subjects, for the progress of the document
        write_matches(done, checkpoint, *names, progress=progress_of(ids, total, "KeyboardInterrupt"))
        raise
    for left in (checkpoint, ledger):
        if exists(spark, left):
            remove(spark, left)
    return path


def _evaluate(args, spark: SparkSession):
    from tessera.plans.evaluation import run_evaluation

    return run_evaluation(spark, args.root, args.testset, lambda: _backend(args), args.repeats, args.repeat_reliability, args.output, args.dry_run)


def run(args: argparse.Namespace, spark: SparkSession):
    return {"match": _match, "segment": _segment, "evaluate": _evaluate}[args.command](args, spark)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    out = run(args, SparkSession.builder.appName("tessera").getOrCreate())
    if out is not None:
        print(out)


if __name__ == "__main__":
    main()
