"""``python -m sonoweft train FOLDER DICTIONARY MODEL``, ``... align FOLDER DICTIONARY MODEL OUT`` and
``... align-one AUDIO TRANSCRIPT DICTIONARY MODEL OUT`` (the transcript is a text or names a file)."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .plans import speech
from .session import ship
from .sources import dictionary, interval_files, model


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sonoweft")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, operands in (("train", ("folder", "dictionary", "model")), ("align", ("folder", "dictionary", "model", "out")), ("align-one", ("audio", "transcript", "dictionary", "model", "out"))):
        p = commands.add_parser(name)
        for o in operands:
            p.add_argument(o)
    commands.choices["train"].add_argument("--iterations", type=int, default=10)
    for name in ("align", "align-one"):
        commands.choices[name].add_argument("--ctm", action="store_true", help="CTM lines beside the interval files")
    a = parser.parse_args(args)
    spark = ship(SparkSession.builder.appName("sonoweft").getOrCreate())
    if a.command == "train":
        trained, likes = speech.train(spark, a.folder, a.dictionary, a.iterations)
        model.save(spark, trained, a.model)
        print(f"{len(trained.phones)} phones, log-likelihood per frame {likes[0]:.3f} to {likes[-1]:.3f}")
        return 0
    begun = time.monotonic()
    lexicon, trained = dictionary.read(spark, a.dictionary), model.load(spark, a.model)
    found = speech.utterances(spark, a.folder, lexicon) if a.command == "align" else speech.single(spark, a.audio, a.transcript, lexicon, known=trained.phones)
    utts = found.persist()
    spans = speech.align(utts, trained).persist()
    speech.write_textgrids(spans, f"{a.out}/textgrids")
    if a.ctm:
        ms = spans.where("tier = 'phones'").selectExpr("utt", "cast(round(xmin * 1000) AS long) AS xmin", "cast(round(xmax * 1000) AS long) AS xmax", "label")
        interval_files.ctm(ms).write.mode("overwrite").text(f"{a.out}/ctm")
    row = speech.timed(speech.summary(utts, spans), time.monotonic() - begun).first()
    print(f"{row.aligned} of {row.utterances} utterances aligned, {row.oov} unknown words, {row.audio} of audio, {row.rtf} of real time")
    return 0 if row.aligned == row.utterances else 1


if __name__ == "__main__":
    raise SystemExit(main())
