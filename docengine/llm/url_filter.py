"""URL filters: fixed host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import free_name

BINS = 1 << 13
NGRAMS = (3, 4, 5)

#: A small labelled table of URLs, 1 to block, 0 to allow.
LABELLED_URLS = [
    ("https://www.cheap-pills.example.com/en/1", 1),
    ("http://cheap-pills.example.net/buy?ref=1", 1),
    ("https://spam-farm.example.org/en/2", 1),
    ("http://www.spam-farm.example.com/page/3", 1),
    ("http://casino-bonus.example.com/win", 1),
    ("https://best-casino-online.example.net/free-spins", 1),
    ("http://buy-viagra-now.example.org/order", 1),
    ("https://viagra-cialis.example.com/discount", 1),
    ("http://xxx-adult-videos.example.net/free", 1),
    ("https://adult-cams.example.com/live", 1),
    ("http://payday-loans-fast.example.org/apply", 1),
    ("https://quick-loan-cash.example.com/apply", 1),
    ("http://free-download-crack.example.net/keygen", 1),
    ("https://warez-torrents.example.org/crack/serial", 1),
    ("http://click-here-win-prize.example.com/claim", 1),
    ("https://link-farm-seo.example.net/backlinks", 1),
    ("http://replica-watches-cheap.example.com/shop", 1),
    ("https://weight-loss-pills.example.org/buy", 1),
    ("http://poker-betting-slots.example.net/bonus", 1),
    ("https://spam-links.example.com/seo/999", 1),
    ("https://www.university.example.org/en/courses", 0),
    ("http://library.example.net/en/catalogue/12", 0),
    ("https://blog.gardening.example.com/en/roses.html", 0),
    ("https://news.example.org/fr/politique/45", 0),
    ("http://m.weather.example.com/de/berlin", 0),
    ("https://docs.software.example.net/en/manual/3", 0),
    ("https://museum.example.org/es/exposiciones", 0),
    ("http://www.recipes.example.com/en/bread", 0),
    ("https://blog.travel.example.net/fr/lyon.html", 0),
    ("https://therin.example.net/en/770", 0),
    ("http://therha.example.com/en/676", 0),
    ("https://blog.tionsh.example.net/es/533/", 0),
    ("https://www.hospital.example.org/en/contact", 0),
    ("http://forum.cycling.example.com/de/thread/88", 0),
    ("https://wiki.chemistry.example.org/en/benzene", 0),
    ("https://city-council.example.net/en/minutes/2020", 0),
    ("http://school.example.org/fr/inscription", 0),
    ("https://m.radio.example.com/en/25", 0),
    ("https://ththin.example.org/en/671", 0),
    ("http://astronomy.example.net/en/galaxies?page=2", 0),
]

#: Fixed values: (verdict, host, start of the path), written together as host + path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (by host + path; the earlier one of two as long) that fits the host or a domain above it and starts the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """Bins of the distinct character n-grams of host and path, each with its own mark (polynomial hash of code points)."""
    bins = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        codes = [ord(mark), *map(ord, text)]
        for n in NGRAMS:
            for i in range(1, len(codes) - n + 1):
                v = codes[0]
                for c in codes[i : i + n]:
                    v = (v * 1000003 + c) & 0xFFFFFFFF
                bins.add((v ^ v >> 15) * 2654435761 >> 7 & BINS - 1)
    return np.fromiter(sorted(bins), np.int64, len(bins))


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def train(labelled: list[tuple[str, int]], rounds: int = 400, rate: float = 2.0, penalty: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the intercept) by gradient descent on the mean log loss; the table is small and fixed in size."""
    x = np.zeros((len(labelled), BINS + 1))
    for k, (url, _) in enumerate(labelled):
        f = features(*split_url(url))
        x[k, f] = 1 / np.sqrt(max(1, len(f)))
        x[k, BINS] = 1
    y, w = np.array([v for _, v in labelled], float), np.zeros(BINS + 1)
    for _ in range(rounds if len(labelled) else 0):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + penalty * w)
    return w


def probability(weights: np.ndarray, host: str, path: str) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(1, len(f))) + weights[BINS]))))


def _judged(batches: Iterator[pa.RecordBatch], weights: np.ndarray, host: str, path: str, name: str, at: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (host, path))
        said = ["block" if probability(weights, h, p) >= at else "allow" for h, p in zip(hosts, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, name])


def judge_urls(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block: the rule's, else the model's).

    A null url, or one without ``://``, has an empty host and path and is judged by the model. No shuffle; repeated urls
    are judged alike. Columns of ``pages`` that have one of these names are replaced, unless it is the url's own.
    """
    weights = train(LABELLED_URLS if labelled is None else labelled)
    rules = RULES if rules is None else rules
    url = free_name(pages, "_url")
    kept = pages.withColumn(url, pages[url_col].cast("string")).drop(*(c for c in ("host", "path", "rule", "verdict") if c != url_col))
    made = kept.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url))).drop(url)
    found = free_name(made, "_rule")
    made = made.withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    model = free_name(made, "_model")
    schema = StructType([*made.schema.fields]).add(model, StringType())
    judged = made.mapInArrow(partial(_judged, weights=weights, host="host", path="path", name=model, at=threshold), schema)
    return judged.withColumn("rule", F.col(f"{found}.rule")).withColumn("verdict", F.coalesce(F.col(f"{found}.verdict"), F.col(model))).drop(found, model)
