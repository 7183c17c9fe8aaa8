import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tidewheel.llm import url_rules as ur
from tidewheel.session import table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain(url):
    """(host, path, rule, verdict by rule)"""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def plain_tokens(url):
    """The tokens of a url, without Spark."""
    host, path, *_ = plain(url)
    scheme = re.match("([A-Za-z]+)://", url or "")
    ending = re.search(r"\.([A-Za-z0-9]{1,5})$", path)
    query = re.search(r"\?([^#]*)", url or "", re.S)
    segments = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", path).split("/")
    out = [f"scheme:{scheme[1]}"] if scheme else []
    out += [f"host:{h}" for h in host.split(".") if h]
    out += ["path:" + ("#" if re.fullmatch(r"\d+", x) else x) for x in segments if x]
    out += [f"ending:{ending[1]}"] if ending else []
    out += [f"query:{q.split('=')[0]}" for q in (query[1].split("&") if query else []) if q.split("=")[0]]
    return set(out)


def plain_rules(rows, support=ur.MIN_SUPPORT, confidence=ur.MIN_CONFIDENCE, lift=ur.MIN_LIFT, least=ur.LEAST, most=ur.MOST):
    """{antecedent: confidence} from [(tokens, bad)], by counting every combination."""
    rows = [(t, b) for t, b in rows if t]
    count, bad = Counter(x for t, _ in rows for x in t), Counter(x for t, b in rows if b for x in t)
    share = sum(b for _, b in rows) / max(len(rows), 1)
    rank = {x: (round(-abs(bad[x] - count[x] * share), 9), x) for x, n in count.items() if n >= least}
    baskets = [(sorted((x for x in t if x in rank), key=rank.get)[:most], b) for t, b in rows]
    n, hits, wins = len(baskets), Counter(), Counter()
    for t, b in baskets:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                hits[c] += 1
                wins[c] += b
    found = {}
    z = ur.errors(sum(w >= least and w >= support * n for w in wins.values()))
    for c, w in wins.items():
        if w >= least and w >= support * n and (sure := w / hits[c]) >= confidence and sure / share >= lift:
            m = hits[c]
            low = (sure + z * z / (2 * m) - z * (sure * (1 - sure) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
            if low >= share:
                found[c] = sure
    return {c: s for c, s in found.items() if not any(set(o) < set(c) and found[o] >= s for o in found)}


def labelled_rows(spark, sf_dir):
    bad = defaultdict(bool)
    for r in table(spark, sf_dir, "labels").collect():
        bad[r["doc_id"]] |= r["quality"] == 0 or r["toxic"] == 1
    pages = table(spark, sf_dir, "pages").select("page_id", "url").collect()
    return pages, [(plain_tokens(r["url"]), bad[r["page_id"]]) for r in pages if r["page_id"] in bad]


def test_documents(spark):
    """The whole query against tokens, counts and rules of its own."""
    sf_dir = "/root/testdata/sf0.1"
    pages, rows = labelled_rows(spark, sf_dir)
    rules = plain_rules(rows)
    assert all(sum(set(c) <= t and b for t, b in rows) >= ur.LEAST for c in rules)
    found = {r["page_id"]: r for r in ur.op10_url_rules(spark, sf_dir).collect()}
    assert set(found) == {r["page_id"] for r in pages}
    for p in pages:
        host, path, rule, verdict = plain(p["url"])
        hit = any(set(c) <= plain_tokens(p["url"]) for c in rules)
        r = found[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if hit else "allow"))


def test_held_out_precision(spark):
    """Rules learned from half of planted labels hold for the other half, and noise gives next to none."""
    rng = random.Random(6)
    rows = []
    for _ in range(3000):
        t = {f"host:{rng.choice('abcdefgh')}", f"path:{rng.choice('klmnop')}", f"query:{rng.choice('uvw')}"}
        rows.append((sorted(t), rng.random() < (0.9 if {"host:a", "path:k"} <= t or "query:w" in t and "host:b" in t else 0.1)))
    learned = ur.mine_rules(spark.createDataFrame(rows[:1500], "tokens array<string>, bad boolean")).collect()
    hit = [b for t, b in rows[1500:] if any(set(r["antecedent"]) <= set(t) for r in learned)]
    assert {tuple(r["antecedent"]) for r in learned} >= {("host:a", "path:k"), ("host:b", "query:w")}
    assert len(hit) > 40 and sum(hit) / len(hit) > 0.8
    noise = [(t, rng.random() < 0.25) for t, _ in rows]
    assert ur.mine_rules(spark.createDataFrame(noise, "tokens array<string>, bad boolean")).count() == 0


def test_rules_of_pages_are_better_than_none(spark):
    """On the given labels, over splits: what rules block in the part they have not seen is bad more often than the rest, or there are no rules."""
    _, rows = labelled_rows(spark, "/root/testdata/sf0.1")
    base = sum(b for _, b in rows) / len(rows)
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        at = len(rows) * 4 // 5
        rules = plain_rules(rows[:at])
        hit = [b for t, b in rows[at:] if any(set(c) <= t for c in rules)]
        assert not hit or sum(hit) / len(hit) > base


def test_urls_of_many_shared_segments(spark):
    rows = [([f"path:s{i}" for i in range(30)], True)] * 8 + [(["path:s0", "x"], False)] * 40
    found = {tuple(r["antecedent"]) for r in ur.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert found and all(len(c) <= ur.MOST for c in found)


def test_mined_rules_are_those_of_counting(spark):
    rows = [(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(["b", "c"], True)] * 10 + [(["c"], False)] * 30
    found = ur.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 0.6, 1.2).collect()
    # "b" always means block, and covers "a b" and "b c", which are no surer
    assert [(r["antecedent"], round(r["confidence"], 6), r["anchor"]) for r in found] == [(["b"], 1.0, "b")]


def test_a_rule_needs_all_its_tokens(spark):
    rows = [(["a", "b"], True)] * 30 + [(["a"], False)] * 60 + [(["b"], False)] * 60
    rules = ur.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 0.6, 1.2)
    urls = spark.createDataFrame([("one", ["a"]), ("both", ["b", "x", "a"]), ("none", [])], "url string, tokens array<string>")
    assert [r["url"] for r in ur.matches(urls, rules).collect()] == ["both"]


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTPS://Ä.Example.ORG/es/x?u=1#f", "https://www.example.org/en/12", "http://a.com?/de/", "http://a.com/de/", "x://org", "x://org/", "http://" + "a" * 50_000 + ".com/fr/", "a://b://c.com/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"verdict": F.lit("clash"), "tokens": F.lit(0), "html": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, None), (6, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        found = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in ur.judge(pages, given).collect()), key=repr)
        assert found == sorted(((i, *plain(u)[:3]) for i, u in rows), key=repr)
    assert ur.judge(pages.limit(0), labels).count() == 0
    verdicts = {r["page_id"]: r["verdict"] for r in ur.judge(pages, labels.limit(0)).collect()}
    assert verdicts[0] == verdicts[1] == "allow" and verdicts[6] == "block" and verdicts[4] == "block"


def test_no_token_of_a_long_url_is_left_out(spark):
    """Each of thirty segments that only bad urls share is a rule of its own, as counting all combinations would find."""
    rows = [([f"path:s{i}" for i in range(30)], True)] * 8 + [(["path:s0", "x"], False)] * 40
    found = ur.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert {tuple(r["antecedent"]) for r in found.collect()} == {(f"path:s{i}",) for i in range(1, 30)}
    urls = spark.createDataFrame([("a", ["path:s29"]), ("b", ["path:s0"])], "url string, tokens array<string>")
    assert [r["url"] for r in ur.matches(urls, found).collect()] == ["a"]
