"""Operators on awkward rows and on nothing, and queries against brute force on the small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, chat_tree, components, decontaminate, html_extract, language_ppm, ngram_join, pii, quality_mcd, queries, sstable, substring_dedup, textkit
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import LONG, PASSAGE

P = pytest.importorskip("public_tokenizers")
BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_quality(spark, awkward, nothing, docs):
    got = {r["doc_id"]: tuple(r)[1:7] for r in queries.op1_quality_mcd(spark, SMALL).collect()}
    assert got == {i: brute.base_rules(t) for i, t in docs}
    out = quality_mcd.judge(awkward).collect()
    assert len(out) == 12 and not any(r["kept"] for r in out if r["base_failed"])
    assert quality_mcd.judge(nothing).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(30, 300))), "en", "s") for i in range(300)] + [(1000 + i, " ".join(word() + "###" for _ in range(80)), "en", "s") for i in range(20)]
    kept = {x["doc_id"]: x["kept"] for x in quality_mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(20))


def test_quality_verdicts_equal_a_search_over_random_starts(spark):
    """The determinant is as small as the best of many random starts finds, and the verdicts are the same."""
    rng, rows = np.random.default_rng(4), []
    for k, (g, n) in enumerate([("en", 240), ("fr", 120)]):
        mix = rng.normal(size=(quality_mcd.DIMENSIONS, quality_mcd.DIMENSIONS))
        x = rng.normal(size=(n, quality_mcd.DIMENSIONS)) @ mix + k
        x[: n // 6] = rng.normal(size=(n // 6, quality_mcd.DIMENSIONS)) * 0.3 + 25  # a cluster of outliers
        rows += [(g, "s", *map(float, r)) for r in x]
    names = [f"x{i}" for i in range(quality_mcd.DIMENSIONS)]
    df = spark.createDataFrame(rows, "gl string, gs string, " + ", ".join(f"{x} double" for x in names))
    fit, groups = quality_mcd.fit_groups(df, textkit.workspace(spark))
    told = {r["gl"]: r for r in fit.collect()}
    assert groups == 2
    floors = np.diag(np.square(quality_mcd.FLOORS))
    for g in told:
        x = np.array([r[2:] for r in rows if r[0] == g])
        best = (np.inf, None)
        for _ in range(60):
            own = x[rng.choice(len(x), quality_mcd.DIMENSIONS + 1, replace=False)]
            for _ in range(60):
                m, c = own.mean(0), quality_mcd.CONSISTENCY * np.cov(own.T, bias=True) + floors
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                own = x[d <= np.sort(d)[int(np.ceil(quality_mcd.SUBSET * len(x))) - 1]]
            best = min(best, (np.linalg.slogdet(c)[1], d), key=lambda b: b[0])
        ours = x - np.array(told[g]["m"])
        d = np.einsum("ij,jk,ik->i", ours, np.array(told[g]["p"]).reshape(len(names), -1), ours)
        assert told[g]["ld"] <= best[0] + 0.02
        assert ((d > quality_mcd.CUTOFF) == (best[1] > quality_mcd.CUTOFF)).all() and (d > quality_mcd.CUTOFF)[: len(x) // 6].all()


def test_near_duplicates(spark, awkward, nothing, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_jaccard(spark, SMALL).collect()}
    assert got == brute.components(docs)
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(awkward).collect()), key=str)
    assert out.count((1, 8, 1)) == 2 and (2, 8, 1) in out and (3, 0, 3) in out and (None, 0, None) in out and (7, 1, 7) in out and len(out) == 12
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.keep_representatives(awkward).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "None"])  # 2 joins 1 and 9 joins 8


def test_near_duplicates_of_one_family(spark):
    """Copies with edits, chains of links and large groups: every link counts, whichever sets are compared."""
    import random

    r = random.Random(7)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"e{r.randrange(9)}"
        rows.append((i, " ".join(w[: r.randint(50, 60)])))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_equal_rows_in_two_partitions(spark):
    """As of a file that is there twice: each row is told, and no shingle counts twice."""
    words = [f"v{i}" for i in range(64)]
    rows = [(1, " ".join(words[:40])), (2, " ".join(words[:28] + words[50:62])), (3, " ".join(words[:39])), (4, "one two three")]
    want, twice = brute.components(rows), spark.sparkContext.parallelize(rows + rows, 2)
    assert want[2][1] == 2 and want[3][1] == 1
    got = ngram_join.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *v) for i, v in want.items() for _ in range(2))


def test_components(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 4)], "a long, b long")
    assert dict(map(tuple, components.connected_components(edges, str(tmp_path)).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6}


def test_substrings(spark, awkward, nothing, docs):
    got = sorted((tuple(r) for r in queries.op3_substring_dedup(spark, SMALL).collect()), key=str)
    assert got == brute.repeats(docs)
    out = substring_dedup.remove_repeats(awkward)
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=str) == brute.repeats(rows)
    assert out.where("doc_id = 8").first()["kept"] == "x y z end" and PASSAGE not in out.where("doc_id = 9").first()["kept"]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substrings_of_equal_rows_in_two_partitions(spark):
    """As of a file that is there twice, and passages that one chunk, or each of two, has several times."""
    words = [f"v{i}" for i in range(300)]
    rows = [(1, " ".join(words[:60] + words[100:160] + words[10:55])), (2, " ".join(words[200:290])), (3, " ".join(words[105:150])), (4, " ".join(["x", *words[210:250], "y", *words[215:252]])), (5, "few words")]
    frame = lambda rows, n: spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
    for given, parts in ((rows, 1), (rows, 5), (rows + rows, 2)):
        out = substring_dedup.remove_repeats(frame(given, parts)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute.repeats(given)


def test_chat_trees(spark, duck):
    from ledgerloom.llm.oracles import ORACLES

    want = {tuple(r) for r in duck(SMALL).sql(ORACLES["op4_chat_tree"]).project("conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars").fetchall()}
    assert {tuple(r) for r in queries.op4_chat_tree(spark, SMALL).collect()} == want
    chats = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, None, None), (None, None, "user", "hi"), (3, 0, "user", "other")], "conv_id long, turn long, role string, text string")
    nodes, leaves = chat_tree.build_trees(chats.withColumn("node", F.lit(1)), BPE, P.PATTERN)
    rows = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert len(rows) == 5 and leaves.count() == 4
    for r in rows.values():
        own = len(r["ids"])
        assert len(r["position_ids"]) == own and len(r["attends"]) == r["depth"] and r["position_ids"][0] == sum(a["end"] - a["start"] for a in r["attends"])
        assert all(a["end"] <= r["seq_start"] for a in r["attends"])
    for tree in {t for t, _ in rows}:  # each token has one place
        taken = sorted((r["seq_start"], r["seq_start"] + len(r["ids"])) for (t, _), r in rows.items() if t == tree)
        assert taken[0][0] == 0 and all(a[1] == b[0] for a, b in zip(taken, taken[1:], strict=False))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_tree.read_back(nodes, leaves, BPE).collect()}
    assert back == {1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "hi"), ("assistant", "no"), ("", "")], None: [("user", "hi")], 3: [("user", "other")]}
    said = {r["conv_id"]: r["loss_text"] for r in chat_tree.read_back(nodes, leaves, BPE).collect()}
    assert said == {1: "yo", 2: "no", None: "", 3: ""}
    blind = chat_tree.read_back(nodes.withColumn("loss", F.lit(None).cast(nodes.schema["loss"].dataType)), leaves, BPE)
    assert not any(r["loss_text"] for r in blind.collect())  # it comes from the mask alone
    nodes, leaves = chat_tree.build_trees(chats.where("false"), BPE, P.PATTERN)
    assert nodes.count() == 0 and leaves.count() == 0


def test_language(spark, awkward, nothing):
    told = queries.op5_language_ppm(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told) and all(0 <= r["score"] <= 1 for r in told)
    out = language_ppm.predict(awkward, language_ppm.fit_model(awkward)).collect()
    assert len(out) == 12 and all(r["lang_pred"] == "und" for r in out if not (r["text"] or "").strip())
    assert language_ppm.predict(awkward, language_ppm.fit_model(nothing)).where("lang_pred != 'und'").count() == 0
    assert language_ppm.predict(nothing, language_ppm.fit_model(awkward)).count() == 0


def test_code_lengths_equal_the_definition():
    """Blended tables against walking the contexts symbol by symbol."""
    import math
    from collections import Counter, defaultdict

    learned, text = {"x": ["abab abba"], "y": ["zzz ab"]}, "abz b"
    model = language_ppm.PpmModel.fit(learned)
    for k, name in enumerate(model.languages):
        seen = defaultdict(Counter)
        for t in learned[name]:
            raw = bytes(language_ppm.ORDER) + t.encode()
            for i in range(language_ppm.ORDER, len(raw)):
                for o in range(language_ppm.ORDER + 1):
                    seen[o, raw[i - o : i]][raw[i]] += 1
        bits, raw = 0.0, bytes(language_ppm.ORDER) + text.encode()
        for i in range(language_ppm.ORDER, len(raw)):
            for o in range(language_ppm.ORDER, -1, -1):
                c = seen.get((o, raw[i - o : i]))
                if not c:
                    continue
                n = sum(c.values()) + len(c)
                if raw[i] in c:
                    bits -= math.log2(c[raw[i]] / n)
                    break
                bits -= math.log2(len(c) / n)
            else:
                bits += 8
        import numpy as np

        got = model.code_lengths(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0, k]
        assert got == pytest.approx(bits, abs=1e-3)


def test_private_data(spark, awkward, nothing, docs):
    want = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute.private(t or "")) for i, t in docs}
    import hashlib

    for r in queries.op6_private_data(spark, SMALL).collect():
        assert r["base_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() and set(filter(None, want[r["doc_id"]].split(","))) <= set(r["spans"].split(","))
    assert pii.find_spans(awkward).count() == 12 and pii.find_spans(nothing).count() == 0
    assert pii.redact_text(awkward).where("text is null").count() == 2


def test_pages(spark, nothing):
    out = queries.op7_html_tree_model(spark, SMALL).collect()
    assert len(out) == spark.read.parquet(f"{SMALL}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in out)
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain &amp; bare"), (4, "<nav><a>x</a></nav><article><p>A  b</p><p>c</article>")], "page_id long, html string").withColumn("text", F.lit(3))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert got[1] == got[2] == "" and got[4] == "A b\nc"


def test_bpe_query_equals_the_library(spark, docs):
    import hashlib

    import tiktoken

    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x := told.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in docs}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op8_byte_bpe(spark, SMALL).collect()} == want


def test_bpe_round_trip(spark, awkward, nothing):
    coded = byte_bpe.encode_documents(awkward, BPE, P.PATTERN)
    back = byte_bpe.decode_documents(coded, BPE).collect()
    assert len(back) == 12 and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.encode_documents(nothing, BPE, P.PATTERN).count() == 0


def test_token_tables(spark, awkward, nothing, tmp_path, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in queries.op9_token_tables(spark, SMALL).collect()}
    at = 0
    for i, t in sorted(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    manifest = sstable.write_tables(awkward, WORDS, str(tmp_path / "a"))
    rows = sstable.read_tables(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9] and all(r["ids"][-1] == 1 for r in rows)
    assert sstable.TableReader(manifest.first()["path"]).get(7)[0].tolist()[:-1] == library.encode("one two", add_special_tokens=False).ids
    assert sstable.write_tables(nothing, WORDS, str(tmp_path / "b")).count() == 0


def test_hot_identifier_spreads_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_TEXT_BYTES", 400)
    rows = [(5, f"text number {i // 4}") for i in range(200)] + [(6, "the same")] * 100 + [(i, "x") for i in range(3)] + [(9, "y")]
    manifest = sstable.write_tables(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path / "hot"))
    out = sstable.read_tables(manifest).orderBy("start").collect()
    assert len(out) == 304 and [r["doc_id"] for r in out] == sorted(i for i, _ in rows) and manifest.agg(F.max("n_docs")).first()[0] < 100


def test_decontamination(spark, awkward, nothing, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    few = docs[:60] + [(d, t) for d, t in docs[60:] if any(x in (t or "") for x in (i[1][:40] for i in items))]
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in queries.op10_decontaminate(spark, SMALL).collect()}
    want = brute.contamination([(d, " ".join(brute.words(t)[:400])) for d, t in few if len(brute.words(t)) <= 400], items)
    assert want and all(got.get(k) == (round(v[0], 9), v[1]) for k, v in want.items())
    plain = {d for d, t in few if len(brute.words(t)) <= 400}
    assert {k for k in got if k[0] in plain} == set(want)
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, None), (None, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(awkward, bench).collect()}
    assert found == {(8, 1), (9, 1), (7, 2)}
    assert decontaminate.matches(awkward, bench.where("false")).count() == 0 and decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.drop_matching(awkward, bench).count() == 9


def test_items_in_blocks(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, "a b c d e f g")], "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(awkward, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 1)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(awkward, bench).collect()} == whole


def test_blocks_do_not_change_similarities(spark, monkeypatch):
    """Items with shingles in common: a similarity is the same whichever block an item is in."""
    common = [f"c{i}" for i in range(12)]
    own = [[f"i{k}_{i}" for i in range(24)] for k in range(6)]
    items = [(k, " ".join(common + w)) for k, w in enumerate(own)] + [(7, "one two"), (8, " "), (9, None), (10, " ".join(own[0]))]
    rows = [(k, " ".join(common + w[:20] + ["x", "y", "z"])) for k, w in enumerate(own)] + [(50, " ".join(["p"] + common + own[1][:22] + ["q", "r"]))]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.matches(df, bench).collect()))
    assert whole == sorted((d, i, pytest.approx(v[0]), v[1], *w) for (d, i), v in brute.contamination(rows, [x for x in items if x[1]]).items() for w in [next(r[4:] for r in whole if r[:2] == (d, i))])
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    assert len(whole) > 5 and sorted(map(tuple, decontaminate.matches(df, bench).collect())) == whole


def test_multi_index_finds_all_within_the_radius_and_prunes():
    import random

    r = random.Random(3)
    items = [(k, " ".join(f"{r.choice('abcdefgh')}{r.randrange(5000)}" for _ in range(40))) for k in range(60)]
    index = decontaminate.BenchmarkIndex(items)
    noise = decontaminate._blocks(np.random.default_rng(1).normal(size=(400, decontaminate.FINGERPRINT)))
    flip = index.prints.copy()
    for row in flip:  # RADIUS bits off, spread evenly over the blocks
        for bit in range(decontaminate.RADIUS):
            row[bit % decontaminate.BLOCKS] ^= np.uint32(1 << bit // decontaminate.BLOCKS)
    near = set(zip(*(x.tolist() for x in index.near(flip, 40)), strict=True))
    assert {(i, i) for i in range(60)} <= near and not len(index.near(noise, 40)[0]) and not len(index.near(flip, 41)[0])
    passed = sum(int(((np.bitwise_count(noise[:, None, b] ^ index.prints[None, :, b]) <= decontaminate.NEAR)).sum()) for b in range(decontaminate.BLOCKS))
    assert passed <= 0.2 * len(noise) * len(items)


def test_recall_near_the_threshold(spark):
    """Edited items around the threshold: nearly all similar windows are found, and nothing else."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(50))) for k in range(40)]
    rows = []
    for d in range(400):
        w = items[d % 40][1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(50)] = word()
        rows.append((d, " ".join([word() for _ in range(r.randrange(20))] + w + [word() for _ in range(9)])))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, want = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(df, bench).collect()}, set()
    for row in rows:  # other items have no word of it
        want |= set(brute.contamination([row], [items[row[0] % 40]]))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 150


def test_long_text_is_read_whole(spark):
    rows = [(1, LONG + " secret@example.com"), (2, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find_spans(df).where("doc_id = 1").first()["spans"][0]["start"] == len(LONG) + 1
