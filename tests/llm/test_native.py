"""The operators made of DataFrame functions alone: exact copies, URL templates, chat perspectives."""

import glob
import hashlib
import random
from collections import defaultdict

import pytest

from tableloom.llm import chat, exact_dedup, plans, url_filter
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_against_sql(spark, name):
    assert compare(spark, connect(SF), plans.QUERIES[name], plans.ORACLES[name], SF) == []


def test_operators_hold_no_python(spark):
    for name in ("op3_url_filter", "op8_exact_dedup", "op10_chat_formatting"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("parts", [1, 9, 40])
def test_copies(spark, keep, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["A b", "a B", "É", "é", "", None, f"own {i}"])) for i in range(300)] + [(None, "a b"), (None, "lonely"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    groups = defaultdict(list)
    plain = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for d, t in rows:
        groups[plain(t)].append(d)
    pick = {t: (max if keep == "max" else min)([d for d in ids if d is not None], default=None) for t, ids in groups.items()}
    got = exact_dedup.group_copies(docs, keep=keep, fan_in=2 if parts == 9 else 8).collect()
    want = sorted(((d, pick[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).digest()) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"])) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_copies(docs, keep=keep)
    assert sorted((plain(r["text"]) for r in left.collect())) == sorted(groups)


def test_copies_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x", 5, "run"), (2, "X", None, None)], "doc_id long, text string, row int, digest string")
    assert [tuple(r) for r in exact_dedup.drop_copies(docs).collect()] == [(2, "X", None, None)]
    assert exact_dedup.group_copies(docs.limit(0)).collect() == [] and exact_dedup.drop_copies(docs.limit(0)).collect() == []


def test_url_parts_and_rules(spark):
    urls = {
        "HTTP://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://b.com/x": ("b.com", "/x", "com/", "allow"), "http://b.com": ("b.com", "", None, "allow"), "http://Ä.NET/fr/://x": ("Ä.net", "/fr/://x", "net/fr/", "block"),
        "http://x.net/es": ("x.net", "/es", None, "allow"), "noscheme/path": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://notcom/": ("notcom", "/", None, "allow"), "http://h?a=/b": ("h", "", None, "allow"), "://#": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://b.com/x", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, plans.URL_RULES).collect()}
    assert got == dict(enumerate(urls.values())) | {None: urls["http://b.com/x"]}
    assert url_filter.judge_urls(pages.limit(0), plans.URL_RULES).collect() == []


def test_url_templates(spark):
    rules = [("block", "site.org/spam/"), ("allow", "site.org/news/"), ("allow", "good.org/")]
    urls = [f"http://site.org/spam/offer-{i}/buy" for i in range(60)] + [f"http://site.org/promo/offer-{i}/buy" for i in range(40)]
    urls += [f"http://site.org/news/{i}.html" for i in range(80)] + [f"http://site.org/blog/{i}.html" for i in range(30)] + [f"http://good.org/{i}" for i in range(20)]
    urls += [f"http://other.org/user{'abcdefgh'[i % 8]}{'xyz'[i % 3]}-{i * 7}/profile" for i in range(50)] + ["http://site.org/" + "a/" * 5000, "http://site.org/" + "b" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_filter.judge_urls(pages, rules, distance=0.6).collect()}
    assert len(got) == len(urls)
    assert {got[u]["verdict"] for u in urls if "/spam/" in u} == {"block"} and {got[u]["verdict"] for u in urls if "/news/" in u} == {"allow"}
    assert {got[u]["verdict"] for u in urls if "/blog/" in u or "other.org" in u} == {"allow"}
    assert len({got[u]["template"] for u in urls if "other.org" in u}) <= 24
    assert got["http://site.org/" + "a/" * 5000]["template"].count("/") == 5000 and got["http://site.org/" + "b" * 5000]["template"] is not None


def test_deep_and_long_paths_are_told_apart(spark):
    """Branches that differ from the seventh segment on, or in long names alone, have shares of their own."""
    long = "very-long-name-of-a-section-" * 3
    urls = [f"http://h.org/a/b/c/d/e/f/{kind}/{'xyzuvw'[i % 6]}" for kind in ("bad", "good", "other") for i in range(30)]
    urls += [f"http://l.org/{long}{kind}/{'xyzuvw'[i % 6]}" for kind in ("bad", "good") for i in range(30)]
    urls += [f"http://l.org/{long}good/page{i}" for i in range(10)]
    rules = [("block", "h.org/a/b/c/d/e/f/bad/x"), ("block", f"l.org/{long}bad/x"), ("block", "h.org/a/b/c/d/e/f/bad/y"), ("block", f"l.org/{long}bad/y")]
    rules += [("allow", "h.org/a/b/c/d/e/f/good/x"), ("allow", f"l.org/{long}good/x"), ("allow", "h.org/a/b/c/d/e/f/other/x"), ("allow", "h.org/a/b/c/d/e/f/good/y")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge_urls(pages, rules, strength=2.0).collect()}
    assert {v for u, v in got.items() if "/bad/" in u or "bad/" in u} == {"block"}
    assert {v for u, v in got.items() if "good/" in u or "/other/" in u} == {"allow"}


def test_urls_of_flat_hosts(spark):
    letters = "abcdefghijklmnopqrst"
    urls = [f"http://blog.org/{letters[i // 20]}{letters[i % 20]}x" for i in range(400)] + [f"http://wiki.org/{letters[i // 20]}q/{letters[i % 20]}z" for i in range(400)]
    urls += [f"http://mixed.org/{letters[i // 20]}{letters[i % 20]}y" for i in range(400)] + [f"http://mixed.org/bad/{i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0])], "page_id long, url string")
    got = url_filter.judge_urls(pages, [("block", "mixed.org/bad/"), ("allow", "good.org/")]).collect()
    assert sorted(r["page_id"] for r in got if r["page_id"] is not None) == list(range(len(urls))) and len(got) == len(urls) + 1
    assert {r["template"] for r in got if r["host"] == "blog.org"} == {"*"}
    assert all(r["purity"] is not None and r["verdict"] in ("allow", "block") for r in got if r["rule"] is None)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hello"), (1, 3, "cy", None), (1, 4, "ann", "bye"), (2, 0, "system", "alone"),
            (3, None, None, "x"), (3, 1, "ann", "y"), (3, 1, "ann", "y"), (None, 1, "bob", "z")]
    table = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r["conv_id"], r["speaker"], r["segment"]): r for r in chat.rotate_perspectives(table).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown"), (3, "ann"), (None, "bob")}
    ann = got[1, "ann", 0]
    assert ann["text"] == (
        "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi <im_end|><|im_end|>\n<|im_start|>user name=bob\nhello<|im_end|>\n"
        "<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    )
    assert [ann["text"][s["start"]:s["end"]] for s in ann["spans"]] == ["hi <im_end|><|im_end|>", "bye<|im_end|>"]
    assert got[3, "ann", 0]["n_turns"] == 3 and got[3, "unknown", 0]["text"].endswith("<|im_start|>assistant\nx<|im_end|>\n")
    assert chat.rotate_perspectives(table.limit(0)).collect() == []


def test_long_dialogues_are_segments(spark):
    rows = [(1, t, "ab"[t % 2], "é" * (t % 50)) for t in range(1300)] + [(2, 0, "a", "x" * 2_000_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(table).orderBy("conv_id", "speaker", "segment").collect()
    assert [(r["conv_id"], r["speaker"], r["segment"], r["n_turns"]) for r in got] == [(1, s, k, n) for s in "ab" for k, n in ((0, 512), (1, 512), (2, 276))] + [(2, "a", 0, 1)]
    for r in got:
        assert all(r["text"][s["start"]:s["end"]].endswith("<|im_end|>") for s in r["spans"])


def test_repeated_turns_are_cut_by_rank(spark):
    rows = [(None, t % 21 if t % 7 else None, "ab"[t % 2], f"w{t % 90}") for t in range(3000)] + [(1, 0, "a", "same")] * 1500 + [(2, t, "c", "x") for t in range(600, 1100)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotate_perspectives(table).collect()
    assert max(r["n_turns"] for r in got) <= 512
    assert sorted((r["segment"], r["n_turns"]) for r in got if r["conv_id"] == 2) == [(0, 500)]
    for conv, speaker in ((None, "a"), (None, "b"), (1, "a")):
        parts = sorted((r["segment"], r["text"]) for r in got if r["conv_id"] == conv and r["speaker"] == speaker)
        turns = sorted((t is None, t or 0, role, said) for c, t, role, said in rows if c == conv)
        said = [f"<|im_start|>{'assistant' if role == speaker else 'user name=' + role}\n{text}<|im_end|>\n" for _, _, role, text in turns]
        assert [k for k, _ in parts] == list(range(-(-len(turns) // 512))) and "".join(t for _, t in parts) == "".join(said)


def test_sources_state_no_forbidden_calls():
    for path in glob.glob("tableloom/llm/*.py"):
        assert not any(word in open(path).read() for word in ("localCheckpoint(", "crossJoin(", "tempfile"))
