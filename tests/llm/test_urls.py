import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from warywire.llm import urls
from warywire.llm.common import table
from warywire.llm.queries import op5_url_models

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def pages(spark, *values):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(values)], "page_id long, url string, html string")


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fit = []
    for rule, verdict in RULES.items():
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def check(spark, frame, rows):
    texts = {r.page_id: r.url for r in frame.select("page_id", "url").collect()}
    for r in rows:
        host, path = parted(texts[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= r.threshold else "block"))


def test_rules_and_verdicts(spark, sf):
    frame = table(spark, sf, "pages")
    rows = op5_url_models(spark, sf).collect()
    assert len(rows) == frame.count()
    check(spark, frame, rows)


def test_models_tell_accepted_from_rejected(spark):
    rows = [r for r in op5_url_models(spark, "/root/testdata/sf0.1").collect() if r.rule]
    right = sum((r.score >= r.threshold) == (r.verdict == "allow") for r in rows)
    assert right / len(rows) > 0.9


def test_odd_urls(spark):
    frame = pages(spark, None, "", "no scheme", "http://", "HTTP://ORG", "x://ORG/", "a://b.org?x/://c", "http://A.Example.ORG/es/1", "http://notorg/",
                  "http://x.com/de", "http://x.com/de/", "http://é.com/fr/?q#f", "a://b://c/d", "http://org/" + "y" * 100_000, "http://example.org/en/1",
                  "http://example.org/en/1")
    check(spark, frame, urls.judge(frame.withColumn("host", F.lit(1)).withColumn("score", F.lit("x"))).collect())
    assert urls.judge(frame.filter("false")).count() == 0
    alone = urls.judge(pages(spark, "http://a.org/", "http://b.net/")).collect()
    assert all(r.verdict == "allow" and r.score == 0 for r in alone)


def plain_scores(accepted, rejected, asked, order):
    """The same interpolation with dictionaries in place of fixed tables."""
    tables = []
    for known in (rejected, accepted):
        pair, alone, kinds = Counter(), Counter(), defaultdict(set)
        for u in known:
            for i, c in enumerate(u):
                for n in range(order + 1):
                    context = tuple(u[i - k] if i >= k else urls.START for k in range(1, n + 1))
                    pair[context, c] += 1
                    alone[context] += 1
                    kinds[context].add(c)
        tables.append((pair, alone, kinds))
    out = []
    for u in asked:
        gain = 0.0
        for i, c in enumerate(u):
            for sign, (pair, alone, kinds) in zip((-1, 1), tables):
                p = 1 / 256
                for n in range(order + 1):
                    context = tuple(u[i - k] if i >= k else urls.START for k in range(1, n + 1))
                    if alone[context]:
                        p = (pair[context, c] + len(kinds[context]) * p) / (alone[context] + len(kinds[context]))
                gain += sign * math.log(p)
        out.append(gain / max(1, len(u)))
    return out


def test_models_against_plain_counts(spark):
    values = [f"http://s{i}.example.org/{lang}/{i}" for i in range(30) for lang in ("es", "fr", "de")] + ["http://t.net/abc", "http://u.com/fr/x", "q"]
    frame = pages(spark, *values)
    model = urls.fit(frame, order=3, n_cells=1 << 20)
    known = urls.accepted_and_rejected(frame).filter("not held").collect()
    of = lambda kind: [bytes(r.url) for r in known if r.kind == kind]
    asked = [v.encode() for v in values] + [b""]
    want = plain_scores(of(1), of(0), asked, 3)
    assert model.scores(asked) == pytest.approx(np.array(want), abs=1e-9)
