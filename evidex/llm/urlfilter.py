"""URL filters on a sorted digest array.

Rules and blocked hosts become one file: the ascending 64-bit xxhash keys of
their strings, then offsets, then the strings themselves.  Spark hands the file
to every executor, which memory-maps it; a batch of urls is turned into all its
candidate strings (each domain suffix of the host with each rule-length prefix
of the path), hashed, probed with one vectorised binary search, and every hit
is confirmed against the stored string, so collisions can't decide.

Cases: a null url, or one without "://", has an empty host and path, which no
rule fits, and is allowed; repeated rows are judged alike; of long hosts only as many
labels are looked up as listed hosts have; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.common import table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts (with all their subdomains) that the method blocks where no rule fits: advertising, gambling, spam.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class DigestArray:
    """keys.npy-like layout: count, keys, string offsets (all 64-bit), then the strings."""

    @staticmethod
    def build(strings: Sequence[str]) -> bytes:
        entries = sorted((xxhash.xxh64_intdigest(s), s) for s in set(strings))
        blobs = [s.encode("utf-8", "surrogatepass") for _, s in entries]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype("<u8")
        return np.array([len(entries)], "<u8").tobytes() + np.array([k for k, _ in entries], "<u8").tobytes() + offsets.tobytes() + b"".join(blobs)

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.keys = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.strings = raw[16 + 16 * n :]

    def find(self, strings: list[str]) -> np.ndarray:
        """Position of each string in the array, or -1."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        found = np.full(len(strings), -1, np.int64)
        at = np.searchsorted(self.keys, hashes)
        live = np.flatnonzero(at < len(self.keys))
        live = live[self.keys[at[live]] == hashes[live]]
        while len(live):  # equal keys stand side by side
            for i in live.tolist():
                k = int(at[i])
                if self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes() == strings[i].encode("utf-8", "surrogatepass"):
                    found[i] = k
            at[live] += 1
            live = live[(found[live] < 0) & (at[live] < len(self.keys))]
            live = live[self.keys[at[live]] == hashes[live]]
        return found

    def string(self, k: int) -> str:
        return self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes().decode("utf-8", "surrogatepass")


def ship(spark: SparkSession, strings: Sequence[str]) -> str:
    """Hands the digest file to all executors, present and to come; its name there."""
    blob = DigestArray.build(strings)
    name = f"digests-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
    if any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        return name  # the same content is there already
    path = os.path.join(tempfile.mkdtemp(prefix="evidex-digests-"), name)
    with open(path, "wb") as f:
        f.write(blob)
    spark.sparkContext.addFile(path)
    return name


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.  A rule is a host and a path that begins with a slash."""
    verdicts = dict(rules)
    # blocked hosts are kept apart from rules by the missing slash
    name = ship(pages.sparkSession, [*verdicts, *blocked])
    lengths = sorted({len(r) - r.index("/") for r in verdicts})
    # longer suffixes than any host that is listed can't be found
    labels = max((s.partition("/")[0].count(".") + 1 for s in (*verdicts, *blocked)), default=0)
    picked = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    schema = T.StructType([picked.schema["id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            split = [host_and_path(u) for u in batch.column(1).to_pylist()]
            probes, owner = [], []
            for i, (host, path) in enumerate(split):
                heads = {path[:n] for n in lengths if len(path) >= n}
                host = ".".join(host.rsplit(".", labels)[-labels:]) if labels else ""
                while host:
                    probes.append(host)
                    probes += [host + h for h in heads]
                    owner += [i] * (1 + len(heads))
                    host = host.partition(".")[2]
            best: list[str | None] = [None] * len(split)
            stop = [False] * len(split)
            found = array.find(probes)
            for at in np.flatnonzero(found >= 0).tolist():
                hit, i = array.string(int(found[at])), owner[at]
                if "/" not in hit:
                    stop[i] = True
                elif best[i] is None or len(hit) > len(best[i]):
                    best[i] = hit
            verdict = [verdicts[b] if b else ("block" if s else "allow") for b, s in zip(best, stop, strict=True)]
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text([h for h, _ in split]), text([p for _, p in split]), text(best), text(verdict)], schema.names)

    return picked.mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url"))


#: The same verdicts in SQL, for tables small enough to check.
_PROBE = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
_HOSTS = ", ".join(f"('{h}')" for h in BLOCKED)
OP6_SQL = rf"""
WITH rules(rule, rhost, rpath, rverdict) AS (VALUES {_PROBE}),
blocked(bhost) AS (VALUES {_HOSTS}),
parts AS (
  SELECT page_id,
         coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
split AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
fits AS (
  SELECT page_id, host, path, rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
stops AS (SELECT DISTINCT page_id FROM split JOIN blocked ON host = bhost OR ends_with(host, '.' || bhost))
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.rverdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split s
LEFT JOIN fits f ON f.page_id = s.page_id AND f.k = 1
LEFT JOIN stops b ON b.page_id = s.page_id
"""
