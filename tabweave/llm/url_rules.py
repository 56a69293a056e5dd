"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern in the usual filter-list notation:

``||``  the start of the host or of one of its labels     ``*``  any characters
``|``   the start or the end of the URL                   ``^``  a separator or the end
``@@``  before a pattern: an exception (allow), which beats every block

A literal token of a rule is a run of letters and digits which every URL that
the rule matches holds as a *whole* token: it is delimited by literal
separators, ``^`` or anchors on both sides.  Each rule is filed under the one of
its literal tokens that the fewest URLs of the table hold.  A URL is cut into
tokens, each token fetches the rules filed under it, and only those run their
regular expression.  Rules without a literal token are tried on every URL.

The rules are a parameter, so their number does not grow with the data; the
index built from them is shipped to the tasks with the code.  One pass counts
the tokens that occur in rules, a second, narrow pass judges; nothing else is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More rules than this belong in a table of their own, not in a task's closure.
MAX_RULES = 100_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"[^a-z0-9_.%-]"


@dataclass(frozen=True)
class PatternRule:
    """One pattern; ``regex`` is searched in the lower-cased URL."""

    text: str

    @property
    def allows(self) -> bool:
        return self.text.startswith("@@")

    @property
    def body(self) -> str:
        return self.text.removeprefix("@@").translate(_UPPER)

    @property
    def regex(self) -> str:
        body, head, tail = self.body, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        parts = {"*": ".*", "^": f"({_SEPARATOR}|$)"}
        return head + "".join(parts.get(c) or re.escape(c) for c in body) + tail

    def tokens(self) -> list[str]:
        """Literal tokens in the order of the pattern."""
        body = self.body
        left, right = body.startswith("|"), body.endswith("|")
        body = body.strip("|")
        found = []
        for m in _TOKEN.finditer(body):
            before = left if m.start() == 0 else body[m.start() - 1] != "*"
            after = right if m.end() == len(body) else body[m.end()] != "*"
            if before and after:
                found.append(m[0])
        return found


@dataclass(frozen=True)
class SiteRule:
    """A host with its subdomains and the start of a path, as in ``org/``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith("." + self.host))


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(_UPPER), path


def token_counts(df: DataFrame, rules: Sequence[PatternRule], url: str = "url") -> dict[str, int]:
    """How many rows hold each token that occurs in a rule; at most one entry per rule token."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.split(F.translate(F.col(url), *_upper_lower()), "[^a-z0-9]+"))
    hits = df.select(F.explode(tokens).alias("token")).where(F.col("token").isin(wanted))
    return dict(tuple(r) for r in hits.groupBy("token").count().collect())


def _upper_lower() -> tuple[str, str]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return upper, upper.lower()


def rarest_token_index(
    rules: Sequence[PatternRule], counts: dict[str, int]
) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token, and those of rules without one; ties go to the longer token."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            index.setdefault(rarest, []).append(i)
        else:
            always.append(i)
    return index, always


def filter_urls(
    df: DataFrame,
    rules: Sequence[str],
    sites: Sequence[SiteRule] = (),
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``(key, host, path, rule, verdict, pattern)``, one row per row of ``df``.

    A site rule that fits decides, the longest one first (``rule``); otherwise
    a matching exception allows, a matching pattern blocks (``pattern`` is the
    first such rule in list order), and ``default`` holds for the rest.

    * A null URL and one without ``://`` have an empty host and path; no site
      rule fits them.  Patterns see a null URL as the empty text.
    * Keys are passed on as they are: null and repeated keys give rows of their
      own.  Other columns of ``df`` are not read, whatever their names.
    * An empty table gives an empty result; an empty rule list lets ``default``
      decide everything.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are shipped to each task")
    patterns = [PatternRule(r) for r in rules]
    index, always = rarest_token_index(patterns, token_counts(df, patterns, url))
    ranked = sorted(sites, key=lambda s: (-len(s.text), -len(s.host), s.text))

    names = ["host", "path", "rule", "verdict", "pattern"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}

        def matches(i: int, text: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(patterns[i].regex, re.S)
            return compiled[i].search(text) is not None

        def pattern(text: str) -> tuple[str, str | None]:
            candidates = set(always).union(*(index.get(t, ()) for t in _TOKEN.findall(text)))
            for allows, verdict in ((True, "allow"), (False, "block")):
                for i in sorted(c for c in candidates if patterns[c].allows is allows):
                    if matches(i, text):
                        return verdict, patterns[i].text
            return default, None

        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                site = next((s for s in ranked if s.fits(host, path)), None)
                verdict, by = pattern((value or "").translate(_UPPER))
                rows.append((host, path, site and site.text, site.verdict if site else verdict, by))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["key", *names])

    slim = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    kind = slim.schema["key"].dataType.simpleString()
    schema = f"key {kind}, host string, path string, rule string, verdict string, pattern string"
    return slim.mapInArrow(judge, schema).withColumnRenamed("key", key)
