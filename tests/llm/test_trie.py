import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from chainlens.llm.trie import numbered, op11_prefix_trie, spliced, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = (*own.get(c - c % 5, [])[:h], *v[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, below = defaultdict(set), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node, m in members.items():
        saved = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += node not in children
            below[node[:d]][1] += saved
    ends = lambda node, m: hashlib.sha256(",".join(str(c) for c in m if made[c] == node).encode()).hexdigest()
    return sorted((m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(children[node]), *below[node], ends(node, m)) for node, m in members.items())


def answer(spark, tmp_path, rows, schema=SCHEMA, **sizes):
    table = spark.createDataFrame(rows, schema).repartition(5)
    if sizes:
        got = trie(*spliced(numbered(table)), **sizes).collect()
    else:
        table.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        got = op11_prefix_trie(spark, str(tmp_path)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def corpus(seed, n=200, longest=12):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randrange(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["a", "b", "straße", "", "long " * 30])))
    return rows


@pytest.mark.parametrize(("block", "size"), [(64, 8192), (3, 8192), (2, 7), (1, 1)])
def test_equals_brute_force(spark, tmp_path, block, size):
    rows = corpus(block)
    same = [("x", "hot"), ("y", "hot 2"), ("x", None)]
    rows += [(c, t, *same[t]) for c in range(1000, 1150) for t in range(3)]  # a third are copies
    rows += [(5000, t, "user", f"{t % 4}") for t in range(60)] + [(5001, t, "user", f"{t % 4}") for t in range(45)]
    rows += [(6001, None, None, None), (6001, 1, "user", None), (6002, 3, None, ""), (None, 1, "user", "x"), (6003, 2, "user", "z"), (6003, 2, "user", "z")]
    assert answer(spark, tmp_path, rows, block=block, size=size) == brute(rows)


def test_long_conversations_over_levels(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}" if t < 150 + 10 * (c % 3) else f"{c} {t}") for c in range(0, 30, 5) for t in range(200)]
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_turnless_alone_and_empty(spark, tmp_path):
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "user", "gone") for c in lone]  # no donor and one turn: all are turnless
    assert answer(spark, tmp_path, rows) == brute(rows)
    assert answer(spark, tmp_path, []) == []
    extra = [(*r, 1, "q") for r in rows]
    assert answer(spark, tmp_path, extra, SCHEMA + ", level long, n string") == brute(rows)
