"""URL rules by a bit-parallel wildcard automaton (Shift-And over multiword masks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: (host, path, verdict): a rule fits its host and all subdomains, below its path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Where no rule fits, these globs over host + path block, and anything else is allowed.
GLOBS = ["*/login*", "*/logout*", "*/cgi-bin/*", "*/track/*", "*/ads/*", "*.exe", "*.zip"]
#: URLs that one automaton run simulates together; longer ones, in bytes, are run one by one.
TOGETHER, LONG = 2048, 4096


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)


class GlobAutomaton:
    """All globs at once: one bit for each position of each glob, in 64-bit words.

    '*' matches any run of bytes, '\\x00' is the end that every text gets. A bit is set if the glob up to it matches the text
    so far; a step shifts by one and masks with the byte, and bits before a '*' hold themselves.
    """

    def __init__(self, globs: list[str]) -> None:
        masks: list[set[int]] = [set() for _ in range(256)]
        first, loops, self.last, at = set(), set(), [], 0
        for glob in globs:
            body = glob.encode() + b"\x00"
            start, fresh = at, True
            for byte in body:
                if byte == ord("*"):
                    if fresh:
                        loops.add(-1 - start)  # may begin anywhere
                    else:
                        loops.add(at - 1)
                    continue
                masks[byte].add(at)
                if fresh:
                    first.add(at)
                    fresh = False
                at += 1
            self.last.append(at - 1)
        self.words = max(1, -(-at // 64))
        floating = {-1 - x for x in loops if x < 0}
        self.masks = np.array([self._pack(m) for m in masks])
        self.first, self.loops, self.floating = self._pack(first), self._pack({x for x in loops if x >= 0}), self._pack(first & floating)
        self.not_first = ~self.first
        whole = lambda words: sum(int(w) << (64 * k) for k, w in enumerate(words))
        self.as_ints = [whole(m) for m in self.masks], whole(self.first), whole(self.loops), whole(self.floating), (1 << 64 * self.words) - 1

    def _pack(self, bits: set[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def _long(self, text: bytes) -> list[bool]:
        """The same steps for one text, with its state in one number."""
        masks, first, loops, floating, full = self.as_ints
        state, begin = 0, first
        for byte in text.replace(b"\x00", b"\x01") + b"\x00":
            state = (((state << 1) & full & ~first) | begin) & masks[byte] | (state & loops)
            begin = floating
        return [bool(state >> bit & 1) for bit in self.last]

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(text, glob): whether the whole text matches."""
        out = np.zeros((len(texts), len(self.last)), bool)
        size = np.array([len(x) for x in texts], int)
        for r in np.flatnonzero(size > LONG):
            out[r] = self._long(texts[r])
        order = np.argsort(size, kind="stable")[:np.count_nonzero(size <= LONG)]
        for k in range(0, len(order), TOGETHER):
            rows = order[k:k + TOGETHER]
            size = np.array([len(texts[r]) + 1 for r in rows])
            wide = np.zeros((len(rows), size.max()), np.uint8)
            for i, r in enumerate(rows):
                wide[i, :size[i] - 1] = np.frombuffer(texts[r].replace(b"\x00", b"\x01"), np.uint8)
            state = np.zeros((len(rows), self.words), np.uint64)
            for j in range(wide.shape[1]):
                live = size > j
                moved = state << np.uint64(1)
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)  # the carry between words
                begin = self.first if j == 0 else self.floating
                step = ((moved & self.not_first) | begin) & self.masks[wide[:, j]]
                state = np.where(live[:, None], step | (state & self.loops), state)
            for g, bit in enumerate(self.last):
                out[rows, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """The verdict on each URL.

    pages: (page_id, url), further columns are ignored. Returns (page_id, host, path, rule, verdict), one row for each input
    row. A null URL, or one without '://', has an empty host and path. The longest rule that fits decides; where none does,
    rule is null, and the URL is blocked if a glob matches host + path and allowed if not. Repeated rows are judged alike.
    An empty table gives an empty result. rules and globs are the operator's parameters, not data, and go to all tasks.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    # a rule's own globs are anchored at a boundary of the host's labels; \x02 stands between host and path, \x03 before the host
    own = [f"\x03{h}\x02{p}*" for h, p, _ in order] + [f"\x03*.{h}\x02{p}*" for h, p, _ in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_glob = GlobAutomaton(own), GlobAutomaton(globs)
        for b in batches:
            hosts, paths = ([(x or "").encode() for x in b.column(c).to_pylist()] for c in ("host", "path"))
            clean = lambda x: x.replace(b"\x02", b"\x01").replace(b"\x03", b"\x01")
            fit = by_rule.matches([b"\x03" + clean(h) + b"\x02" + clean(p) for h, p in zip(hosts, paths)])
            fit = fit[:, :len(order)] | fit[:, len(order):]
            bad = by_glob.matches([h + p for h, p in zip(hosts, paths)]).any(1)
            rule, verdict = [], []
            for k in range(len(hosts)):
                r = order[int(fit[k].argmax())] if fit[k].any() else None
                rule.append(r and r[0] + r[1])
                verdict.append(r[2] if r else "block" if bad[k] else "allow")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host || path, '/login|/logout|/cgi-bin/|/track/|/ads/|\.exe$|\.zip$') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)
"""
