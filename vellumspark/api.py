"""What a user calls: compile a corpus to packages, validate packages, inspect them; and the same from a command line."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.plans import atlases as atlas_plans
from vellumspark.plans import faces as face_plans
from vellumspark.plans import images as image_plans
from vellumspark.plans import packages
from vellumspark.plans.compile import Corpus
from vellumspark.sources import documents
from vellumspark.sources.fonts import Registry
from vellumspark.sources.fonts import read_folder as read_fonts
from vellumspark.sources.shared import scope, written

USAGE = """usage: python -m vellumspark.api compile INPUTS --out FOLDER [--files] [--css FILE]... [--fonts FOLDER] [--images FOLDER]
       python -m vellumspark.api validate PACKAGES
       python -m vellumspark.api inspect PACKAGES
INPUTS: files or a pattern of .md, .markdown, .html, .htm. PACKAGES: a Parquet folder of (doc_id, bytes), or a folder of package
files, which --files writes. FOLDER may be -, for the package of one document on standard output. FONTS: .ttf files, supplementary ones in its folder `supplement`. IMAGES: what sources of images name."""


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, kind, source, error of files."""
    return documents.read_files(spark, path).withColumn("doc_id", F.xxhash64("path"))


def compile_corpus(
    docs: DataFrame, css: list[str] | None = None, atlases: DataFrame | None = None, images: DataFrame | None = None, keep: str | bool = True, fonts: Registry | None = None, files: DataFrame | None = None, check: bool = True
) -> DataFrame:
    """doc_id, bytes, error. docs: doc_id, kind, source. keep: a shared folder for the parsed documents, which many views read; True: a new one.

    fonts draw the atlases where none are given, and files (path, content) hold the images; an image that is missing or can't be
    decoded fails its document. check: packages are validated, and one that isn't valid fails with its first eight issues.
    """
    corpus = Corpus(docs, css, keep=keep)
    if atlases is None and fonts is not None:
        atlases = written(atlas_plans.build(corpus, fonts), "atlases")
    if images is None and files is not None:
        images = written(image_plans.load(corpus, files), "images")
    pkgs = packages.pack(corpus, docs, atlases, images)
    return packages.checked(pkgs) if check else pkgs


def missing_codepoints(docs: DataFrame, fonts: Registry, css: list[str] | None = None) -> DataFrame:
    """doc_id, cp: the codepoints of each document that no face has. Nothing is drawn for it."""
    return face_plans.missing_codepoints(Corpus(docs, css), fonts)


def validate_corpus(pkgs: DataFrame) -> DataFrame:
    return packages.validate(pkgs)


def inspect_corpus(pkgs: DataFrame) -> DataFrame:
    return packages.report_text(packages.inspect(pkgs))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """0: all is well, 1: a document failed or a package isn't valid, 2: not understood."""
    if len(args) < 2 or args[0] not in ("compile", "validate", "inspect"):
        print(USAGE, file=sys.stderr)
        return 2
    command, path, rest = args[0], args[1], args[2:]
    given: dict[str, str] = {}
    sheets, as_files = [], False
    while rest:
        if rest[0] == "--files" and command == "compile":
            as_files, rest = True, rest[1:]
            continue
        if len(rest) < 2 or rest[0] not in ("--out", "--css", "--fonts", "--images") or command != "compile":
            print(USAGE, file=sys.stderr)
            return 2
        if rest[0] == "--css":
            with open(rest[1], encoding="utf-8") as f:
                sheets.append(f.read())
        else:
            given[rest[0]] = rest[1]
        rest = rest[2:]
    spark = spark or SparkSession.builder.getOrCreate()
    with scope():  # tables of the plans go when the command is done
        return run(spark, command, path, given, sheets, as_files)


def run(spark: SparkSession, command: str, path: str, given: dict[str, str], sheets: list[str], as_files: bool) -> int:
    if command == "compile":
        if "--out" not in given:
            print(USAGE, file=sys.stderr)
            return 2
        return compile_files(spark, path, given["--out"], sheets, given.get("--fonts"), given.get("--images"), as_files)
    pkgs = read_packages(spark, path)
    if command == "inspect":
        for r in inspect_corpus(pkgs).toLocalIterator():
            print(f"package {r['doc_id']}\n{r['report']}")
        return 0
    found = False
    for r in validate_corpus(pkgs).toLocalIterator():
        found = True
        print(f"{r['doc_id']} {r['section']}: {r['message']}")
    return int(found)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, bytes of a Parquet folder, or of package files where there are some."""
    files = packages.read_files(spark, path)
    return files if files.head() is not None else spark.read.parquet(path)


def compile_files(spark: SparkSession, path: str, out: str, sheets: list[str], fonts: str | None, images: str | None, as_files: bool) -> int:
    docs = read_corpus(spark, path)
    if docs.where("error = 'unknown extension'").head() is not None:
        print("unknown extension", file=sys.stderr)
        return 2
    if out == "-" and len(docs.limit(2).collect()) > 1:
        print("one document at a time goes to standard output", file=sys.stderr)
        return 2
    registry = read_fonts(spark, fonts) if fonts else None
    files = image_plans.read_folder(spark, images) if images else spark.createDataFrame([], "path string, content binary")
    corpus = Corpus(docs, sheets)
    atlases = written(atlas_plans.build(corpus, registry), "atlases") if registry else None
    done = written(packages.checked(packages.pack(corpus, docs, atlases, written(image_plans.load(corpus, files), "images"))), "compiled", None if as_files or out == "-" else out)
    if as_files or out == "-":
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        named = done.join(docs.select("doc_id", name.alias("name")), "doc_id")
        if out != "-":
            packages.write_files(named, out)
        elif rows := named.where("bytes is not null").limit(1).collect():
            sys.stdout.buffer.write(rows[0]["bytes"])
    if atlases is not None:
        for r in atlas_plans.missing_codepoints(atlases).groupBy("doc_id").agg(F.sort_array(F.collect_set("cp")).alias("cps")).toLocalIterator():
            print(f"{r['doc_id']}: no face has {' '.join(f'U+{c:04X}' for c in r['cps'])}", file=sys.stderr)
    bad = 0
    for r in done.where("error is not null").select("doc_id", "error").toLocalIterator():
        bad = 1
        print(f"{r['doc_id']}: {r['error']}", file=sys.stderr)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
