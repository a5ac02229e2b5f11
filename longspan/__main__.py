"""``python -m longspan [-d | -t | -i] PATH -O FOLDER``: pack, unpack, test or list files."""

from __future__ import annotations

import argparse
import getpass
import sys

from . import api
from .options import DIGESTS, METHODS
from .sources.config import find_config, options_from


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("longspan", description=__doc__)
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("-d", "--decompress", action="store_true")
    mode.add_argument("-t", "--test", action="store_true")
    mode.add_argument("-i", "--info", action="store_true")
    p.add_argument("path")
    p.add_argument("-O", "--outdir", default=".")
    p.add_argument("-S", "--suffix")
    p.add_argument("-L", "--level", type=int)
    p.add_argument("-R", "--match-level", type=int)
    p.add_argument("-m", "--method", choices=sorted(METHODS))
    p.add_argument("-T", "--threshold", type=int)
    p.add_argument("-H", "--hash", choices=sorted(DIGESTS))
    p.add_argument("-e", "--encrypt", action="store_true")
    p.add_argument("-E", "--cipher", choices=("AES128", "AES256"))
    p.add_argument("-C", "--comment")
    p.add_argument("-D", "--delete", action="store_true", default=None)
    p.add_argument("-f", "--force", action="store_true", default=None, help="replace files that exist")
    p.add_argument("-K", "--keep-broken", action="store_true", default=None)
    p.add_argument("-c", "--check", action="store_true", help="read archives back after writing")
    p.add_argument("--password", help="asked for if it is needed and not given")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    given = {"suffix": a.suffix, "level": a.level, "match_level": a.match_level, "method": a.method, "threshold": a.threshold, "digest": a.hash, "comment": a.comment, "delete": a.delete, "replace": a.force, "keep_broken": a.keep_broken}
    cipher = a.cipher or ("AES128" if a.encrypt else None)
    options = options_from(find_config(), **{k: v for k, v in {**given, "cipher": cipher}.items() if v is not None})
    password = a.password.encode() if a.password else None
    if password is None and options.cipher != "NONE":
        password = getpass.getpass("Passphrase: ").encode()
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if a.test:
        out = api.test(spark, a.path, options, password)
    elif a.info:
        out = api.info(spark, a.path, options)
    elif a.decompress:
        out = api.decompress(spark, a.path, a.outdir, options, password)
    else:
        out = api.compress(spark, a.path, a.outdir, options, password, a.check)
    failed = 0
    for r in out.toLocalIterator():
        print("\t".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None))
        failed += "error" in out.columns and r["error"] is not None
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
