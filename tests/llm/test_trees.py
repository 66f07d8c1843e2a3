"""Prefix trees of conversations: places, ancestors and round trips on random and long conversations."""

import random
from collections import defaultdict

import pytest

from ledgerloom.llm import chat_tree

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.tiktoken")


def test_layout_of_random_conversations(spark):
    """A subtree fills one stretch of its tree, ancestors are those of the conversation, and every conversation comes back; equal ones and beginnings of others, a long one, and a first turn of all."""
    r, chats = random.Random(8), []
    said = [("user", "hi"), ("user", "x"), ("assistant", "yo"), ("assistant", "no no"), ("system", "be"), ("", "")]
    for i in range(60):
        turns = [("user", "hi")] * (i % 3 > 0) + [r.choice(said) for _ in range(r.choice([1, 2, 3, 8, 20]))]
        if i % 5 == 4 and chats:
            turns = list(r.choice(chats))[: r.randint(1, 30)] + [r.choice(said)] * r.randint(0, 2)
        chats.append(turns)
    chats.append([("user", "hi"), *[(("assistant", "user")[k % 2], f"turn {k}") for k in range(300)]])
    rows = [(i, k, *t) for i, turns in enumerate(chats) for k, t in enumerate(turns)]
    r.shuffle(rows)
    nodes, leaves = chat_tree.build_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BPE, P.PATTERN)
    back = {x["conv_id"]: [(t["role"], t["text"]) for t in x["turns"]] for x in chat_tree.read_back(nodes, leaves, BPE).collect()}
    assert back == dict(enumerate(chats))
    by_tree = defaultdict(list)
    for n in nodes.collect():
        by_tree[n["tree"]].append(n)
    prefixes = {tuple(c[: k + 1]) for c in chats for k in range(len(c))}
    assert sum(map(len, by_tree.values())) == len(prefixes)
    for own in by_tree.values():
        own.sort(key=lambda n: n["seq_start"])
        ends = [n["seq_start"] + len(n["ids"]) for n in own]
        assert [n["seq_start"] for n in own] == [0, *ends[:-1]]
        places = {n["seq_start"]: i for i, n in enumerate(own)}
        for i, n in enumerate(own):
            above = [own[places[a["start"]]] for a in n["attends"]]
            assert len(above) == n["depth"] and all(len(a["attends"]) == k and a["seq_start"] + len(a["ids"]) == s["end"] for k, (a, s) in enumerate(zip(above, n["attends"], strict=True)))
            first = sum(len(a["ids"]) for a in above)
            assert n["position_ids"] == list(range(first, first + len(n["ids"])))
            below = [k for k, m in enumerate(own) if n["seq_start"] in {a["start"] for a in m["attends"]}]
            assert below == list(range(i + 1, i + 1 + len(below)))
