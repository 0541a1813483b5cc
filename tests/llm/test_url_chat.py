"""URL filter and chat formatting against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from flowprofile.llm import chat, url_filter

URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/x?y#z", "http://a.b.example.net/en/", "http://a.example.net/de", "http://net/", "http://net", "http://xnet/",
    "HTTP://WWW.EXAMPLE.COM/de/?q", "http://example.com/DE/", "http://org/fr/a", "http://forg/fr/a", "ftp://x.org/fr/#http://y", "x?u=http://z.com/casino", "http://casino.com/",
    "http://casinos.com/", "http://cheap.com/free", "http://free.com/free/free", "http://ads-track.example.com/", "http://e.com/sex,xxx", "http://e.com/\nwin/bets", "http://é.com/ads/é",
    "http://example.net/en/casino", "http://" + "a." * 3000 + "net/",
]


def expected(url):
    whole = url or ""
    host = path = ""
    if "://" in whole:
        after = whole.split("://", 1)[1]
        host = re.split(r"[/?#]", after, maxsplit=1)[0]
        path = re.split(r"[?#]", after[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in whole)
    hits = lambda term: len(re.findall(f"(?<![a-z0-9]){term}(?![a-z0-9])", low))
    strict, soft = sum(map(hits, url_filter.STRICT_TERMS)), sum(hits(t) > 0 for t in url_filter.SOFT_TERMS)
    verdict = best[1] if best else "block" if strict or soft >= 2 else "allow"
    return host, path, best and best[0], verdict, strict, soft


def test_urls_against_plain_python(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[4]])]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.strict_hits, r.soft_hits) == expected(rows[r.page_id][1]), rows[r.page_id][1]


def test_url_filter_without_terms_or_rules_and_empty(spark):
    df = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    assert url_filter.judge_urls(df, rules=(), strict=(), soft=()).first().verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again [+] &amp; <s>"), (1, 2, "assistant", "</s>[INST] x &lt; [/INST]"), (1, 3, "assistant", ""), (1, 4, "system", None),
    (2, 0, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 5, "user", "no id"), (None, None, "assistant", "null turn 🙂"),
    (4, 0, "assistant", "x" * 30000), (5, 0, "[INST]", "odd role"), (5, 1, "</s>", "odd role"),
]


def test_conversations_come_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(4)
    out = chat.format_conversations(df)
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    digests = {r.conv_id: r for r in chat.digests(out).collect()}
    by_id = {}
    for c, n, r, t in TURNS:
        by_id.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    assert {r.conv_id for r in back} == set(by_id)
    for row in back:
        turns = [(r, t) for _, _, r, t in sorted(by_id[row.conv_id])]
        assert [tuple(t) for t in row.turns] == turns
        assert row.loss == "".join(t for r, t in turns if r == "assistant")
        assert row.formatted.count(chat.END) == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        d = digests[row.conv_id]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (d.n_turns, d.turns_sha256, d.formatted_chars) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(row.formatted))
        assert (d.loss_chars, d.loss_sha256) == (len(row.loss), hashlib.sha256(row.loss.encode()).hexdigest())


def test_contract_conversation_and_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).count() == 0
    (row,) = chat.digests(chat.format_conversations(chat.with_extra_conversation(spark, none))).collect()
    text = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-7, 2, len(text), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "&amp;lt;", "[[<<&&", "&#91;", "plain"])
def test_escape_is_reversible(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert row.u == text and "[" not in row.e and "<" not in row.e


def test_formatting_uses_spark_expressions_only(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("Scan ExistingRDD", ""))


def test_long_conversations_are_masked_in_order(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {t} é&<[" * (t % 4)) for t in range(3001)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(table).select("loss_mask", chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert got["loss"] == "".join(text for _, _, role, text in rows if role == "assistant") and len(got["loss_mask"]) == 1500
