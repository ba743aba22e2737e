"""URL rules in a sorted digest array.

Rules are strings ``host + path prefix``. Their 64-bit xxhash keys are sorted into one array that
is stored beside the offsets and bytes of the full strings in the shared folder; Spark's file
distribution brings the files to each executor, which memory-maps them, so all tasks of a machine
share one copy in the page cache. A URL is probed with every suffix of its host at label borders combined with every
prefix of its path that is as long as some rule's path: each batch makes one vector of keys per
path length and finds them by binary search. A hit counts only after the stored string equals the
probe, so hash collisions change nothing. The longest rule that fits wins.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and they get the
default verdict. Rules may repeat (the last action stands). Rows are mapped one to one; null ids
and repeated rows stay; other columns are ignored."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from quarry.llm.common import open_fs
from quarry.session import scratch_path

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class RuleArray:
    """The mapped files: keys (ascending), offsets into the strings, path lengths, actions."""

    def __init__(self, folder: str, name: str):
        at = lambda part: os.path.join(folder, f"{name}-{part}.npy")
        self.keys = np.load(at("keys"), mmap_mode="r")
        self.offsets = np.load(at("offsets"), mmap_mode="r")
        self.strings = np.load(at("strings"), mmap_mode="r")
        self.blocks = np.load(at("blocks"), mmap_mode="r")
        self.path_lengths = np.load(at("lengths")).tolist()

    @staticmethod
    def build(rules: dict[str, str], folder: str, name: str) -> list[str]:
        """Write the files; returns their paths. The rule list is given by the caller and held in
        the driver: 50 million rules are about 5 GB there, the documented bound of this form."""
        text = [r.encode() for r in rules]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in text], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        text = [text[i] for i in order]
        actions = list(rules.values())
        parts = {
            "keys": keys[order],
            "offsets": np.concatenate([[0], np.cumsum([len(t) for t in text], dtype=np.int64)]).astype(np.int64),
            "strings": np.frombuffer(b"".join(text), dtype=np.uint8),
            "blocks": np.array([actions[i] == "block" for i in order], dtype=bool),
            "lengths": np.array(sorted({len(r) - len(split_rule(r)[0]) for r in rules}), dtype=np.int64),
        }
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        for part, values in parts.items():
            with fs.open_output_stream(f"{base}/{name}-{part}.npy") as f:
                np.save(f, values)
        return [f"{folder.rstrip('/')}/{name}-{part}.npy" for part in parts]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of the rule equal to each probe, or -1."""
        n = len(self.keys)
        found = np.full(len(probes), -1, dtype=np.int64)
        if not n or not probes:
            return found
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys, side="left")
        for i in np.flatnonzero((at < n) & (self.keys[np.minimum(at, n - 1)] == keys)):
            k = int(at[i])
            while k < n and self.keys[k] == keys[i]:
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == probes[i]:
                    found[i] = k
                    break
                k += 1
        return found


def split_rule(rule: str) -> tuple[str, str]:
    cut = rule.find("/")
    return (rule, "") if cut < 0 else (rule[:cut], rule[cut:])


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lowered; path up to ``? #``."""
    if url is None or (cut := url.find("://")) < 0:
        return "", ""
    rest = url[cut + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def host_suffixes(host: str) -> list[str]:
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge_batch(urls: list[str | None], rules: RuleArray, default: str) -> tuple[list, list, list, list]:
    hosts, paths = map(list, zip(*map(split_url, urls))) if urls else ([], [])
    suffixes = [host_suffixes(h) for h in hosts]
    best = np.full(len(urls), -1, dtype=np.int64)
    size = np.full(len(urls), -1, dtype=np.int64)
    for n in rules.path_lengths:
        probes, owner = [], []
        for i, (own, path) in enumerate(zip(suffixes, paths)):
            if len(path) >= n:
                probes += [(s + path[:n]).encode() for s in own]
                owner += [i] * len(own)
        hit = rules.find(probes)
        for j in np.flatnonzero(hit >= 0):
            i, length = owner[j], len(probes[j].decode())
            if length > size[i]:
                best[i], size[i] = hit[j], length
    rule = [None if k < 0 else rules.strings[rules.offsets[k] : rules.offsets[k + 1]].tobytes().decode() for k in best]
    verdict = [default if k < 0 else "block" if rules.blocks[k] else "allow" for k in best]
    return hosts, paths, rule, verdict


_ARRAYS: dict[str, RuleArray] = {}


def judge_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each page. ``rules``: 'host/path-prefix' -> 'allow' or
    'block'. A map over the url column alone; no shuffle."""
    sc = pages.sparkSession.sparkContext
    name = f"urls-{uuid.uuid4().hex}"
    for path in RuleArray.build(rules, scratch_path(pages.sparkSession, "url-rules"), name):
        sc.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ARRAYS:
            _ARRAYS[name] = RuleArray(SparkFiles.getRootDirectory(), name)
        for b in batches:
            out = judge_batch(b.column(1).to_pylist(), _ARRAYS[name], default)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in out]], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


OP9_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
         translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
rules(r_host, r_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT s.page_id, s.host, s.path, r_host || r_path AS rule, action
  FROM split s LEFT JOIN rules ON (s.host = r_host OR ends_with(s.host, '.' || r_host)) AND starts_with(s.path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM fit
QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) = 1"""
