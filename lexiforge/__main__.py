"""Command line: ``analyze PATH --reference DOCS`` writes reports; ``hypo PATH --reference DOCS`` tests commands, from a file or one by one."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import corpus as oc
from lexiforge.operators import hypotheses as hy
from lexiforge.operators import language as lg
from lexiforge.operators import report
from lexiforge.operators.staging import staged
from lexiforge.sources import loader


def session(commands: Iterable[str], test: Callable[[str], tuple[str, str]], say: Callable[[str], None] = print) -> int:
    """Test each command that comes in until the input or the word quit ends it; gives the number of tests."""
    n = 0
    for line in map(str.strip, commands):
        if line in ("quit", "exit", "q"):
            break
        if line == "help":
            say("gloss TOKEN = MEANING near ANCHOR | role TOKEN ROLE | affix -X = MEANING | values SIGN=VALUE ... in LANGUAGE")
        elif line:
            verdict, evidence = test(line)
            say(f"[HYPOTHESIS] {verdict}: {evidence}")
            n += 1
    return n


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexiforge")
    p.add_argument("action", choices=["analyze", "hypo"])
    p.add_argument("path")
    p.add_argument("--reference", required=True, help="Parquet of documents (text, lang) that make the reference tables")
    p.add_argument("--out", default="lexiforge-report")
    p.add_argument("--hypotheses")
    p.add_argument("--decipher", default="", help="language codes, separated by commas")
    p.add_argument("--iterations", type=int, default=6000)
    p.add_argument("--tier2", action="store_true", help="treat every document as unknown")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexiforge").getOrCreate()
    known = spark.read.parquet(a.reference).withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text", "lang")
    freq, model = staged(lg.frequencies(known)), staged(lg.trigram_model(known))
    docs = loader.load(spark, a.path)
    commands = loader.command_lines(spark, a.hypotheses) if a.hypotheses else None
    if a.action == "analyze":
        reports, results = report.analyze(docs, freq, model, commands, [x for x in a.decipher.split(",") if x], a.tier2, a.iterations, loader.options()["model_key"])
        report.write(reports, results, a.out)
        print(f"reports are in {a.out}")
        return
    c: DataFrame = staged(oc.corpus(loader.safe(docs)).drop("raw"))
    t, lex = staged(oc.tokens(c)), staged(lg.lexicon(freq))

    def test(line: str) -> tuple[str, str]:
        found = hy.verdicts(c, c, t, [line], lex).select("verdict", "evidence").first()
        return (found["verdict"], found["evidence"]) if found else ("UNTESTABLE", "no document")

    print(session(commands if commands is not None else sys.stdin, test), "commands tested")


if __name__ == "__main__":
    main()
