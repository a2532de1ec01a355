"""quillon: quote one item, or search all of them, from the command line."""

from __future__ import annotations

import argparse
import sys

from quillon.errors import QuillonError


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("ref", nargs="?", help="item_id or citation")
    p.add_argument("--corpus", default="corpus", help="its directory")
    p.add_argument("--manifest", default="MANIFEST.tsv")
    p.add_argument("--grep", metavar="REGEX", help="search every item")
    p.add_argument("--in-force-only", action="store_true", help="search text in force only")
    given = p.parse_args(argv)
    if not (given.ref or given.grep):
        p.error("name an item to quote, or --grep a pattern")
    try:
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        from quillon.operators.search import Corpus, printed
        from quillon.sources import shared

        spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
        corpus = Corpus(spark, given.corpus, given.manifest)
        if not given.grep:
            print(corpus.quote(given.ref))
            return 0
        hits = shared.written(printed(corpus.grep(given.grep, given.in_force_only)).select("authority_rank", "item_id", "line_no", "printed"), "hits")
        for h in hits.orderBy("authority_rank", "item_id", "line_no").toLocalIterator():
            print(h["printed"])
        n, items = hits.agg(F.count("*"), F.countDistinct("item_id")).first()
        print(f"\n{n} line(s) in {items} item(s).\nA count says where to read; read before concluding from it.")
        return 0 if n else 1
    except QuillonError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
