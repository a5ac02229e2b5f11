"""Options of a run: levels, methods, thresholds, and the rules between them."""

from __future__ import annotations

from dataclasses import dataclass

MINIMUM_MATCH = 31
GREAT_MATCH = 1024
LONGEST_TOKEN = 0xFFFF
STORED_BELOW = 64

#: method -> (block type code, container codec code)
METHODS = {
    "none": (3, 0),
    "bzip2": (4, 0),
    "lzo": (5, 0),
    "lzma": (6, 1),
    "gzip": (7, 0),
    "zpaq": (8, 2),
    "bzip3": (9, 3),
    "zstd": (10, 4),
}
SUPPORTED = ("none", "bzip2", "lzo", "lzma", "gzip", "zstd")
METHOD_OF_TYPE = {t: m for m, (t, _) in METHODS.items()}

#: level -> (MB of anchors, sampled low bits, equal anchors kept)
MATCH_LEVELS = {
    1: (2, 4, 2),
    2: (4, 4, 2),
    3: (8, 4, 2),
    4: (16, 4, 3),
    5: (32, 4, 4),
    6: (32, 2, 6),
    7: (64, 1, 16),
    8: (64, 1, 32),
    9: (64, 1, 128),
}
ZSTD_LEVELS = {1: 2, 2: 4, 3: 5, 4: 7, 5: 12, 6: 15, 7: 17, 8: 18, 9: 22}

#: name -> (code, bytes)
DIGESTS = {
    "CRC": (0, 4),
    "MD5": (1, 16),
    "RIPEMD": (2, 20),
    "SHA256": (3, 32),
    "SHA384": (4, 48),
    "SHA512": (5, 64),
    "SHA3_256": (6, 32),
    "SHA3_512": (7, 64),
    "SHAKE128_16": (8, 16),
    "SHAKE128_32": (9, 32),
    "SHAKE128_64": (10, 64),
    "SHAKE256_16": (11, 16),
    "SHAKE256_32": (12, 32),
    "SHAKE256_64": (13, 64),
}
CIPHERS = {"NONE": (0, 0), "AES128": (1, 16), "AES256": (2, 32)}
FILTERS = {"none": 0, "x86": 1, "arm": 2, "armt": 3, "ppc": 4, "sparc": 5, "ia64": 6, "arm64": 7, "riscv": 8, "delta": 128}


@dataclass(frozen=True)
class Options:
    """One run.  ``threshold`` is the gate's percentage, 0 to switch it off."""

    method: str = "lzma"
    level: int = 7
    match_level: int = 0  # 0: as ``level``
    threshold: int = 100
    filter: str = "none"
    delta: int = 0
    digest: str = "MD5"
    cipher: str = "NONE"
    cost: int = 14  # exponent of the password's stretching cost
    chunk_bytes: int = 64 << 20
    block_bytes: int = 10 << 20
    comment: str = ""
    zstd_level: int = 0
    dictionary: int = -1  # code of an LZMA dictionary, -1: by level
    check: bool = False  # read back what was written
    suffix: str = ".lsp"
    output: str = ""
    output_dir: str = ""
    keep_broken: bool = False
    replace: bool = False
    delete: bool = False

    def __post_init__(self):
        def must(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        must(self.method in METHODS, f"unknown method {self.method!r}")
        must(1 <= self.level <= 9, "level must be 1 to 9")
        must(self.match_level in range(10), "match level must be 0 to 9")
        must(0 <= self.threshold <= 100, "threshold must be 0 to 100")
        must(self.filter in FILTERS, f"unknown filter {self.filter!r}")
        must(self.filter != "delta" or self.delta in DELTAS, "delta must be 1 to 16, or 32 to 256 in steps of 16")
        must(self.digest in DIGESTS, f"unknown digest {self.digest!r}")
        must(self.cipher in CIPHERS, f"unknown cipher {self.cipher!r}")
        must(1 <= self.cost <= 24, "stretching cost must be 2 ** 1 to 2 ** 24")
        must(self.chunk_bytes > 0 and self.block_bytes > 0, "sizes must be positive")
        must(len(self.comment.encode()) <= 64, "a comment has 64 bytes at most")
        must(-1 <= self.dictionary <= 40, "a dictionary code is 0 to 40")
        must(0 <= self.zstd_level <= 22, "zstd level must be 1 to 22")
        must(not (self.output and self.output_dir), "give an output name or an output folder, not both")

    @property
    def anchors(self) -> tuple[int, int, int]:
        return MATCH_LEVELS[self.match_level or self.level]

    @property
    def gated(self) -> bool:
        """The gate is off for gzip, lzo and unpacked blocks, and with any filter."""
        return self.threshold > 0 and self.method not in ("gzip", "lzo", "none") and self.filter == "none"


DELTAS = (*range(1, 17), *range(32, 257, 16))


def delta_code(delta: int) -> int:
    """Stored value 1 to 31 of a delta distance."""
    if delta not in DELTAS:
        raise ValueError(f"no code for delta {delta}")
    return delta if delta <= 16 else delta // 16 + 15


def delta_of(code: int) -> int:
    return code if code <= 16 else (code - 15) * 16
