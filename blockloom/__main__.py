"""python -m blockloom [--gray | --color] [--size WIDTHxHEIGHT] [--out FOLDER] [PATH]: compress text images and report."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from blockloom.plans import pipeline
from blockloom.plans.config import VQConfig
from blockloom.sources import images


def main(args: list[str], spark: SparkSession | None = None) -> int:
    path, mode, out, config = "img.txt", None, None, VQConfig()
    rest = list(args)
    while rest:
        arg = rest.pop(0)
        if arg in ("--gray", "--color"):
            mode = arg[2:]
        elif arg in ("--out", "--size") and rest:
            value = rest.pop(0)
            if arg == "--out":
                out = value
            else:
                width, _, height = value.partition("x")
                config = VQConfig(width=int(width), height=int(height))
        elif arg.startswith("-"):
            print(f"unknown option: {arg}\n{__doc__}", file=sys.stderr)
            return 1
        else:
            path = arg
    spark = spark or SparkSession.builder.appName("blockloom").getOrCreate()
    pixels = images.scan_text(spark, path, config.width, config.height, mode)
    result = pipeline.run(pixels, config)
    print(pipeline.report(result, config))
    if out:
        pipeline.write_outputs(result, pixels, config, out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
