"""The corpus operators against brute force on small texts with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import common, components, decontaminate, host_rules, importance, language_id, line_dedup, ngram_join, pieces, sketch, substring_dedup, url_filter, zip_warc

WS = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gämma", "delta", "x1", "42", "le", "chat", "été", "und", "der", "$$#", "word"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = " ".join(f"p{i}" for i in range(60))
    line = "This  boilerplate line is shared by very many of the documents!"
    rows = [(i, text(rng.randint(1, 120)), "en", f"s{i % 3}") for i in range(30)]
    base = [f"w{i}" for i in range(200)]
    rows += [(100 + k, " ".join(w if (j * 7 + k) % 97 else f"edit{k}" for j, w in enumerate(base)), "en", "s0") for k in range(12)]
    rows += [(200 + k, f"{text(20)} {shared} {text(25)}", "en", "s1") for k in range(6)]
    rows += [(300 + k, f"{text(9)}\n\t{line if k % 2 else line.upper()} \n{text(5)}\n\n", "en", "s2") for k in range(7)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, " \n\t ", "en", "s1"), (403, "two words", "en", "s1"), (404, "two words", "en", "s1"),
             (None, text(50), "en", None), (None, None, None, None), (405, "word " * 90, "en", "s2"), (406, text(6000), "en", "s2"),
             (300, rows[-7][1], "en", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "doc_id long, text string, lang string, source string").withColumns({
        "n_words": F.lit("old"), "kept": F.lit(1), "ids": F.lit(2), "id": F.lit("clash"), "key": F.lit(0), "n": F.lit(0)}).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(got, want):
    assert Counter(got) == Counter(want)


def test_substring_dedup(docs, empty):
    texts = [WS.findall(r[1] or "") for r in made()]
    seen = Counter(tuple(w[i:i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for (i, *_), w in zip(made(), texts):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    same([tuple(r) for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept").collect()], want)
    assert any(w[2] for w in want)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_groups_split(docs, monkeypatch):
    whole = substring_dedup.substring_dedup(docs).select("doc_id", "n_removed").collect()
    monkeypatch.setattr(substring_dedup, "GROUP", 1)  # every group takes longer prefixes
    same(map(tuple, substring_dedup.substring_dedup(docs).select("doc_id", "n_removed").collect()), map(tuple, whole))


def shingles(text):
    w = WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def joined(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def joined_ids(rows):
    return [(i, c) for i, _, c in joined(rows)]


def test_ngram_join(docs, empty):
    found = ngram_join.classes(docs).select("id", "n", "component")
    same(map(tuple, found.collect()), joined(made()))
    assert ngram_join.classes(empty).count() == 0 and ngram_join.one_of_each(empty).columns == empty.columns


def test_ngram_join_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 3)  # near copies meet across blocks
    same(map(tuple, ngram_join.classes(docs).select("id", "n", "component").collect()), joined(made()))


def test_one_of_each_with_repeated_rows(docs):
    rows = made()
    least = {}
    for (i, t, *_), (_, n, c) in zip(rows, joined(rows)):
        least.setdefault((c, n) if n and c is not None else (i, t, n), []).append(i)
    kept = ngram_join.one_of_each(docs).select("doc_id", "text").collect()
    texts = Counter(tuple(shingles(r["text"])) and frozenset(shingles(r["text"])) for r in kept if r["text"] and r["text"].strip())
    assert max(texts.values()) == 1                                        # no two rows of one set, null ids and repeated rows included
    wordless = [r for r in rows if not shingles(r[1])]
    assert sum(not shingles(r["text"]) for r in kept) == len(wordless)


def test_links_grow_with_the_group(spark, monkeypatch):
    """Near copies by the dozen: links handed on stay below three per text, however large the group."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    handed, real = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda e: handed.append(e.count()) or real(e))
    base = [f"w{i}" for i in range(300)]
    for n in (64, 128):
        handed.clear()
        rows = [(k, " ".join(w if j != 2 * k + 1 else f"edit{k}" for j, w in enumerate(base))) for k in range(n)]
        found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("component").distinct().collect()
        assert [r[0] for r in found] == [0] and max(handed[1:]) <= 3 * n


def test_sets_travel_once_and_without_unique_shingles(spark, monkeypatch):
    """Of a set only shingles that others have too are moved; they are staged once, however many blocks are visited."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 3)
    kept, real = [], ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name="stage": (out := real(df, name), kept.append(out))[0])
    passage, base = [f"p{i}" for i in range(40)], [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([f"own{k}x{i}" for i in range(400)] + passage)) for k in range(8)]
    rows += [(100 + k, " ".join(w if j != 7 * k + 1 else f"edit{k}" for j, w in enumerate(base))) for k in range(8)]
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "component").collect()
    assert sorted(map(tuple, found)) == sorted(joined_ids(rows))
    held = [df.select(F.sum(F.octet_length("shingles"))).first()[0] for df in kept if "shingles" in df.columns]
    assert len(held) == 1 and held[0] <= 8 * 8 * (40 + 60)


def quilt(n):
    """``n`` texts of four passages, each of which another text has too: all hang together, and no two are alike."""
    passage = lambda a, b: [f"p{min(a, b)}and{max(a, b)}w{i}" for i in range(30)]
    return [[w for far in (1, -1, 7, -7) for w in passage(k, (k + far) % n)] for k in range(n)]


def test_unlike_texts_do_not_visit(spark, monkeypatch):
    """Texts that share passages, but too little to be linked, lie in one group of many blocks; their sets stay in their blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    staged, real = defaultdict(list), ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name="stage": (out := real(df, name), staged[name].append(out))[0])
    rows = [(k, " ".join(words)) for k, words in enumerate(quilt(160))]
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "component").collect()
    assert sorted(map(tuple, found)) == [(k, k) for k in range(160)]
    assert staged["placing"][0].agg(F.max("blocks")).first()[0] >= 20
    assert sum(x.count() for x in staged["guests"]) <= 16


def test_near_copies_of_texts_in_one_group(spark, monkeypatch):
    """Clusters of edited and cut copies, several blocks each, that hang together by shared passages."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 3)
    rng, rows = random.Random(4), []
    for k, words in enumerate(quilt(16)):
        for i in range(1 + k % 9):
            copy = [w if rng.random() > 0.01 * (i % 3) else f"e{k}x{i}x{j}" for j, w in enumerate(words)]
            rows.append((100 * k + i, " ".join(copy[:len(copy) - rng.randrange(0, 25)])))
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n", "component")
    same(map(tuple, found.collect()), joined(rows))
    assert 16 < len({c for *_, c in joined(rows)}) < len(rows)


def test_near_copies_lie_together(spark, monkeypatch):
    """Clusters as large as a block are placed in few blocks of a group of many."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    placed, real = [], ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name="stage": (out := real(df, name), name == "placing" and placed.append(out))[0])
    rows = [(k * 10 + i, " ".join(words[:len(words) - i])) for k, words in enumerate(quilt(24)) for i in range(8)]
    assert ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("component").distinct().count() == 24
    sets = {r["rk"]: r["id"] // 10 for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("rk", "id").collect()}
    blocks = defaultdict(set)
    for r in placed[0].collect():
        blocks[sets[r["rk"]]].add(r["block"])
    assert sum(map(len, blocks.values())) <= 3 * len(blocks)


def test_stages_leave_no_shuffle_files(spark):
    left = lambda: sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, kept = left(), spark.range(1000).repartition(7, "id")
    table = common.stage(kept.groupBy(F.col("id") % 10).count(), "counts")
    hashes = kept.mapInArrow(lambda batches: (sketch.pack(np.sort(np.asarray(b.column("id")).astype(np.uint64) % np.uint64(50))) for b in batches), sketch.PACKED)
    assert sketch.Repeated(hashes, 512, 1 << 22).occurrences.sum() > 0
    for _ in range(100):  # they are removed in the background
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and table.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(common.FREES_SHUFFLES, "false") == "false"


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert Counter(r["label"] for r in components.components(edges).collect()) == {0: 41, 100: 2}


def test_line_dedup(docs, empty):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t, *_ in made():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    hot = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t, *_ in made():
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or i == hot[key(x)]]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    out = line_dedup.line_dedup(docs)
    same([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()], want)
    assert hot and out.where("n_dropped > 0").select(F.min(F.size("dropped_runs"))).first()[0] == 1
    assert line_dedup.line_dedup(empty).count() == 0


def test_host_rules(docs, empty):
    want = []
    for i, t, *_ in made():
        w = WS.findall(t or "")
        tri = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WS.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)))
    same([tuple(r) for r in host_rules.host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()], want)
    assert host_rules.host_rules(empty).count() == 0


def test_bad_host_goes_as_a_whole(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "short", f"h{i % 20}") for i in range(400)] + [(1000 + i, good if i % 8 == 0 else "bad", "spam") for i in range(80)]
    kept = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept")
    assert kept.where("source = 'spam'").isEmpty() and kept.count() > 300


def test_leaks_with_other_values_and_case(spark, docs):
    item = "Alice buys 12 apples for 3 dollars and gives Bob 12 of them before 5 hours pass, how many apples does Alice keep"
    other = item.replace("12", "77").replace("Alice", "Carol").replace("3", "9")
    broken = item.replace("12", "77", 1).replace("Alice", "Dora", 1)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    texts = {1: f"so {item} then", 2: other, 3: broken, 4: item.upper(), 5: "nothing here at all", 6: None, 7: ""}
    found = decontaminate.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench)
    assert {r["doc_id"]: r["items"] for r in found.where("contaminated").collect()} == {1: [1], 2: [1], 4: [1]}
    assert not decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count()


def test_leak_behind_a_text_of_its_shape(spark):
    item = "Alice buys 12 apples for 3 dollars and gives Bob 12 of them before 5 hours pass, how many apples does Alice keep"
    broken = item.replace("12", "77", 1).replace("Alice", "Dora", 1)
    texts = {1: f"{broken} and then {item}", 2: f"{item} and then {broken}", 3: f"{broken} and then {broken}"}
    found = decontaminate.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in found.where("contaminated").collect()} == {1: [1], 2: [1]}


def test_leaks_of_dense_items(spark):
    bench = spark.createDataFrame([(1, "What is 12 + 35 - 7?"), (2, "Maria Lopez Meets Peter Brown In Old Madrid Near Gran Via")], "item_id long, text string")
    texts = {1: "so What is 12 + 35 - 7? then", 2: "WHAT IS 12 + 35 - 7", 3: "What is 12 + 36 - 8?", 4: "as Maria Lopez Meets Peter Brown In Old Madrid Near Gran Via",
             5: "Karla Gomez Meets Frank Green At New York Near Fifth Avenue", 6: None}
    found = decontaminate.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench)
    assert {r["doc_id"]: r["items"] for r in found.where("contaminated").collect()} == {1: [1], 2: [1], 4: [2]}


def test_components_join_an_edge_once(spark, monkeypatch):
    rng = random.Random(9)
    # a path, a star around its largest node, cliques that hang together, an edge to itself
    edges = [(i, i + 1) for i in range(300)] + [(2000, 1000 + i) for i in range(200)] + [(3000 + rng.randrange(60), 3000 + rng.randrange(60)) for _ in range(400)] + [(5000, 5000)]
    sizes, staged = [], components.stage

    def seen(df, name="stage"):
        out = staged(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out
    monkeypatch.setattr(components, "stage", seen)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert sum(sizes[1:]) <= sizes[0] / 2


def test_dense_windows_are_read_off_the_placeholders(spark):
    rng = random.Random(5)
    rows = [[rng.choice("012abcd") for _ in range(n)] for n in (0, 1, 4, 7, 8, 9, 30, 60)] + [["0"] * 20, ["a"] * 20, ["0", "1", "2", "a"] * 6]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    for length in (1, 3, 4, 8):
        got = {r["i"]: sorted(r["at"]) for r in df.select("i", decontaminate._dense_windows(F.col("t"), length).alias("at")).collect()}
        assert got == {i: [k for k in range(len(r) - length + 1) if 2 * sum(w not in "012" for w in r[k:k + length]) < length] for i, r in enumerate(rows)}


def test_url_rules(spark):
    urls = ["https://x.Example.com/en/a?b", "http://www.example.com/en/", "http://example.com", "ftp://a.net/es/1#x", "a.net/es/", None, "http://b.net/de/1", "http://com/x", "http://notcom/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("old"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.url_filter(pages).collect()}
    assert got[0] == ("x.example.com", "/en/a", "example.com/en/") and got[1] == ("www.example.com", "/en/", "www.example.com/en/")
    assert got[2] == ("example.com", "", None) and got[3] == ("a.net", "/es/1", "net/es/") and got[4] == got[5] == ("", "", None)
    assert got[7] == ("com", "/x", "com/") and got[8][2] is None
    assert url_filter.url_filter(pages.where("false")).count() == 0


def test_url_shares_of_all_labelled(spark, monkeypatch):
    urls = [f"http://h{i}.net/es/{i}" for i in range(40)] + [f"http://h{i}.com/{i}" for i in range(40)]
    seen, share = [], url_filter._suffix_share
    monkeypatch.setattr(url_filter, "_suffix_share", lambda labelled, *a: seen.append(labelled.count()) or share(labelled, *a))
    pages = spark.createDataFrame(list(enumerate(urls + urls[:1] * 40)), "page_id long, url string")
    assert url_filter.url_filter(pages, most_training=20).count() == 120 and seen == [120, 120]


def test_zip_packages(spark):
    big = "<p>" + "é" * 80
    rows = [(3, "u", big), (1, "v", big), (2, "w", "short"), (5, "x", "short"), (4, None, None), (None, "y", big), (1, "v2", big), (9, "a\r\nb", "line\r\n\r\nline")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = zip_warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    assert Counter((r["id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(3, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "response", None), (5, "response", None), (4, "response", None), (9, "response", None)])
    for r in got:
        own = next(h or "" for i, u, h in rows if i == r["id"] and (u or "").replace("\r", "%0D").replace("\n", "%0A") == r["uri"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(own), hashlib.sha256(own).hexdigest())
        assert r["payload"] == (own if r["record_type"] == "response" else b"")
    assert zip_warc.round_trip(pages.where("false")).count() == 0


def test_zip_directories(spark, tmp_path):
    from fieldtrace.llm.common import new_path
    where = new_path(spark, "warc")
    pages = spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    for row in zip_warc.write_packages(zip_warc.decide(pages), where).collect():
        path = row["path"].removeprefix("file:")
        path = "/" + path.lstrip("/")
        with zipfile.ZipFile(path) as z, open(path, "rb") as f:  # another reader finds the same members
            assert z.testzip() is None
            f.seek(0, 2)
            for name, (at, n) in zip_warc.members(f, f.tell()).items():
                f.seek(at)
                assert f.read(n) == z.read(name)
    plain = tmp_path / "plain.zip"
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("archive/data.warc.gz", b"abc")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    with open(plain, "rb") as f:
        assert list(zip_warc.members(f, plain.stat().st_size)) == ["archive/data.warc.gz"]


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    own = {"xx": "lorem ipsum dolor sit amet elit".split(), "yy": "der hund geht nach hause heute".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "dolores ipsums", "xx"), (2, "hunde gehen", "yy"), (3, None, "und"), (4, "42 -- 7", "und"), (5, "", "und")], "doc_id long, text string, want string")
    assert language_id.language_id(test, model).where("lang_pred <> want or not score between 0 and 1").count() == 0
    assert language_id.language_id(empty, language_id.train(empty)).count() == 0


def test_rare_language_keeps_its_words(spark):
    def letters(i):
        return "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, " ".join(f"b{letters(j)}" for j in range(i % 7, 60)), "big") for i in range(50)] + [(100, "zuzu wixo quva", "rare"), (101, "wixo zuzu", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "zuzu quva", "rare"), (2, "zuzus wixon", "rare"), (3, "bdb bec", "big"), (4, "zuzu quva", "rare"), (5, None, "und")], "doc_id long, text string, want string")
    whole = language_id.language_id(test, language_id.train(docs)).collect()
    assert all(r["lang_pred"] == r["want"] for r in whole)
    few = language_id.language_id(test, language_id.train(docs, most_words=10)).collect()  # the bound is on what is broadcast
    same([(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in few], [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in whole])


def test_kth_largest(spark):
    values = [random.Random(5).gauss(0, 10) ** 3 for _ in range(5000)] + [7.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 5500):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_importance(spark, docs, empty):
    rng = random.Random(7)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    out = importance.importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert out.where("selected <> (doc_id % 5 > 0)").count() <= 3
    assert importance.importance_sample(docs, labels).count() == docs.count() and importance.importance_sample(empty, labels).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 5])
def test_pieces_equal_the_library(docs, empty, most):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.load()
    odd = docs.sparkSession.createDataFrame([(1, "a  b\t\r\n c"), (2, "👩 é ².x½"), (3, "international" * 30), (4, "  ")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    for r in pieces.decode(pieces.encode(both, model, most_units=most), model).collect():
        assert r["ids"] == (None if r["text"] is None else lib.encode(r["text"])) and r["decoded"] == r["text"]
    assert pieces.encode(empty, model).count() == 0


def test_words_are_cut_in_one_pass_and_ids_spelt_at_once():
    import pyarrow as pa
    model = pieces.load()
    pattern, rng, passes = re.compile(model.unit), random.Random(3), []

    class Counting:
        def findall(self, text):
            passes.append(text)
            return pattern.findall(text)

    texts = ["".join(rng.choice("  ab1.\n\u2581é²👩") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    parts = list(dict.fromkeys(w for t in texts for w in pieces.words(t)))
    flat, owner = pieces.cut(parts, Counting())
    found = [[] for _ in parts]
    for u, i in zip(flat, owner.tolist()):
        found[i].append(u)
    assert found == [pattern.findall(pieces.SPACE + w.replace(" ", pieces.SPACE)) for w in parts]
    assert len(passes) == 1 + sum(not w or w[-1] == " " for w in parts) < len(parts) / 4
    counted = Counter()
    for b in pieces._distinct([pa.RecordBatch.from_pydict({"text": pa.array([*texts, None, ""], pa.string())})], model.unit):
        counted.update(dict(zip(b.column("unit").to_pylist(), b.column("n").to_pylist())))
    assert counted == Counter(u for t in texts for u in pieces.units(t, pattern))
    spelt = pieces._spellings(model)
    known = dict(enumerate(spelt.to_pylist()))
    ids = [i for i, b in known.items() if b is not None][:600]
    lists = [None, [], *([rng.choice(ids) for _ in range(rng.randint(0, 5))] for _ in range(200)), None]  # byte pieces alone spell no valid UTF-8
    want = [None if x is None else b"".join(known[i] for i in x)[1:].decode("utf-8", "replace") for x in lists]
    rows = pa.array(lists, pa.list_(pa.int32()))
    assert pieces._texts(rows, spelt).to_pylist() == want and pieces._texts(rows.slice(1), spelt).to_pylist() == want[1:]


def test_workers_map_one_table_of_units(spark):
    model, text = pieces.load(), "two words  and a gap " * 3
    rows = [{"unit": pieces.SPACE + w, "ids": [i, i + 1]} for i, w in enumerate(["two", "words", "and", "a"])]
    packed = [[np.array([pieces._key(r["unit"]) for r in rows], np.uint64).tobytes(), np.full(4, 2, np.uint32).tobytes(), np.array([r["ids"] for r in rows], np.uint16).tobytes()]]
    reader = pieces.Lookup.share(spark, packed, np.uint16).open()
    assert all(isinstance(x, np.memmap) for x in (reader.key, reader.start, reader.n, reader.ids))
    more = {pieces.SPACE + "gap": [7], pieces.SPACE: [8], pieces.SPACE * 2 + "and": [9, 9, 9]}
    ids, lengths, missing = reader.encode([text, None, "a two", "gap"], re.compile(model.unit), [more, {}, {}, {}])
    once = [0, 1, 1, 2, 9, 9, 9, 3, 4, 7]
    assert lengths.tolist() == [31, 0, 4, 0] and missing == [set(), set(), set(), {pieces.SPACE + "gap"}]
    assert ids.tolist() == once * 3 + [8] + [3, 4, 0, 1]


def test_texts_are_cut_without_running_the_pattern_over_them(spark):
    import pyarrow as pa
    model, rng = pieces.load(), random.Random(11)

    class Kinds:
        """Tells single characters apart, and is never run over a text."""

        def __init__(self, pattern):
            self.pattern, self.asked = re.compile(pattern), 0

        def fullmatch(self, text):
            self.asked += 1
            assert len(text) == 2
            return self.pattern.fullmatch(text)

    texts = ["".join(rng.choice("   ab1.\n\u2581é²👩ßµ\x00₁漢") for _ in range(rng.randint(1, 14))) for _ in range(600)] + [None, "", " ", "\u2581", None, "x" * 300]
    rows = pa.array(["left out", *texts], pa.string()).slice(1)
    for unit in (model.unit, rf"{pieces.SPACE}*[^{pieces.SPACE}]+|{pieces.SPACE}+"):
        pattern, want = Kinds(unit), [pieces.units(t, re.compile(unit)) for t in texts]
        coded, counts = pieces.Cutter(pattern).cut(rows)
        assert counts.tolist() == [len(w) for w in want] and coded.to_pylist() == [u for w in want for u in w]
        known = sorted({u for w in want for u in w} - {pieces.SPACE + "x" * 300})
        lengths = [rng.randint(0, 4) for _ in known]
        packed = [[np.array([pieces._key(u) for u in known], np.uint64).tobytes(), np.array(lengths, np.uint32).tobytes(), np.arange(sum(lengths)).astype(np.uint16).tobytes()]]
        ids_of = dict(zip(known, np.split(np.arange(sum(lengths)), np.cumsum(lengths)[:-1])))
        reader = pieces.Lookup.share(spark, packed, np.uint16).open()
        more = {pieces.SPACE + "x" * 300: [7, 8]}
        ids, n, missing = reader.encode(rows, pattern, [{}] * (len(texts) - 1) + [more])
        spelt = [[x for u in w for x in (more[u] if u in more else ids_of[u].tolist())] for w in want]
        assert n.tolist() == [len(x) for x in spelt] and ids.tolist() == [i for x in spelt for i in x] and not any(missing)
        assert reader.encode(rows, pattern, [{}] * len(texts))[2][-1] == set(more)
        assert pattern.asked <= 2 * (128 + 12)
    assert reader.n.dtype == np.uint8
    long = pieces.Lookup.share(spark, [[np.array([5], np.uint64).tobytes(), np.array([300], np.uint32).tobytes(), np.zeros(300, np.uint16).tobytes()]], np.uint16).open()
    assert long.n.tolist() == [300]
    runs = list(pieces._runs(pa.array(["a" * pieces.TOGETHER, "b", None, "c" * pieces.TOGETHER, "d", "e"])))
    assert runs == [(0, 2), (2, 5), (5, 6)] and list(pieces._runs(pa.array([], pa.string()))) == []


def test_viterbi(spark):
    table = [("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -2.0), ("abc", 3, -5.0), ("bc", 4, -1.2), ("c", 5, -3.0), (pieces.SPACE, 6, -0.5), (pieces.SPACE + "a", 7, -2.5)]
    model = pieces.Model(tuple(table), tuple(range(100, 356)), False, rf"{pieces.SPACE}*[^{pieces.SPACE}]+|{pieces.SPACE}+", 3)
    score = {p: (i, s) for p, i, s in table}

    def best(word):
        paths = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            paths[e] = max((paths[s][0] + score.get(word[s:e], (0, -1e6))[1], paths[s][1] + [score[word[s:e]][0]] if word[s:e] in score else paths[s][1] + [100 + b for b in word[s:e].encode()])
                           for s in range(max(0, e - 3), e) if word[s:e] in score or e - s == 1)
        return paths[-1][1]
    texts = ["abcab", "cab bca", "axbc", "a b c"]
    got = pieces.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        assert r["ids"] == [i for u in pieces.units(r["text"], re.compile(model.unit)) for i in best(u)]
