"""Option files: ``KEY = VALUE`` lines, ``#`` comments, keys in any case."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import DIGESTS, FILTERS, METHODS, Options

_METHOD_NAMES = {m: m for m in METHODS} | {"matches": "none"}
_DIGEST_OF_CODE = {str(code): name for name, (code, _) in DIGESTS.items()}


UNLIMITED = 1 << 62  # a chunk of the whole input


def config_rows(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of each setting line, keys in lower case."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line LIKE '%=%'")
    return lines.select(F.lower(F.trim(F.element_at(F.split("line", "=", 2), 1))).alias("key"), F.trim(F.element_at(F.split("line", "=", 2), 2)).alias("value"))


def parse_config(text: str) -> dict[str, str]:
    """The same for text at hand; later lines win."""
    out = {}
    for line in text.splitlines():
        key, mark, value = line.split("#", 1)[0].partition("=")
        if mark and key.strip():
            out[key.strip().lower()] = value.strip()
    return out


def options_from(settings: dict[str, str], **more) -> Options:
    """Options from settings; unknown keys are ignored, wrong values raise.

    ``hash`` is a digest by number or name, or yes for MD5; ``encrypt`` a cipher by number or name, or yes for the
    first; ``processors``, ``nice``, ``verbosity``, ``showprogress`` and ``locale`` are the cluster's business and
    checked only; ``tmpdir`` is ``spark.checkpoint.dir``.
    """
    out: dict = {}
    yes = lambda v: v.lower() in ("yes", "1", "true", "on")
    for key, value in settings.items():
        low = value.lower()
        if key == "compressionmethod":
            out["method"] = _METHOD_NAMES[low]
        elif key == "compressionlevel":
            out["level"] = int(value)
        elif key == "matchlevel":
            out["match_level"] = int(value)
        elif key == "threshold":
            out["threshold"] = int(value) if low not in ("no", "off") else 0
        elif key in FILTERS and yes(value):
            out["filter"] = key
        elif key == "delta":
            out |= {"filter": "delta", "delta": int(value)}
        elif key in ("hash", "hashcode"):
            if low not in ("no", "off"):
                out["digest"] = "MD5" if yes(value) and low != "1" else _DIGEST_OF_CODE.get(low, value.upper())
        elif key == "hashcheck":
            out["check"] = yes(value)
        elif key == "encrypt":
            if low not in ("no", "off", "0"):
                out["cipher"] = {"1": "AES128", "2": "AES256"}.get(low, "AES128" if yes(value) else value.upper())
        elif key == "costfactor":
            out["cost"] = int(value)
        elif key == "lzotest":
            if low == "no":
                out["threshold"] = 0
        elif key == "unlimited":
            if yes(value):
                out["chunk_bytes"] = UNLIMITED
        elif key == "window":
            out.setdefault("chunk_bytes", int(value) * 100_000_000)
        elif key == "dictionarysize":
            if not 0 <= int(value) <= 40:
                raise ValueError("a dictionary code is 0 to 40")
            out["dictionary"] = int(value)
        elif key in ("processors", "nice"):
            int(value)
        elif key == "comment":
            out["comment"] = value
        elif key == "suffix":
            out["suffix"] = value
        elif key == "outputdirectory":
            out["output_dir"] = value
        elif key in ("replacefile", "deletefiles", "keepbroken"):
            out[{"replacefile": "replace", "deletefiles": "delete", "keepbroken": "keep_broken"}[key]] = yes(value)
    return Options(**(out | more))


def find_config(names: tuple[str, ...] = ("./longspan.conf", "~/.longspan/longspan.conf", "/etc/longspan/longspan.conf")) -> dict[str, str]:
    """The first option file there is; none with LONGSPAN=NOCONFIG in the environment."""
    if os.environ.get("LONGSPAN") == "NOCONFIG":
        return {}
    for name in map(os.path.expanduser, names):
        if os.path.isfile(name):
            with open(name) as f:
                return parse_config(f.read())
    return {}
