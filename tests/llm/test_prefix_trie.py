import random
import zlib
from hashlib import sha256

from corpusmill.llm.common import Stash
from corpusmill.llm.prefix_trie import list_digests, prefix_trie, rolled_up

SCHEMA = "conv_id long, turn long, role string, text string"


def mark(r):
    role, text = r[2] or "", r[3] or ""
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    """The contract by dictionaries of tuples."""
    conv = {}
    for r in rows:
        if r[0] is not None:
            conv.setdefault(r[0], []).append(r)
    for c, own in conv.items():
        conv[c] = [(r[2] or "", r[3] or "") for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, mark(r)))]
    full = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(conv.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + own[h:])
    members, children = {}, {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    sums, out = {}, []
    for n in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(n, [])]
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        sums[n] = (sum(s[0] for s in below) or 1, own + sum(s[1] for s in below))
        ends = ",".join(map(str, sorted(c for c in members[n] if len(full[c]) == len(n))))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(below), *sums[n], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def told(spark, rows):
    return sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_random_conversations_against_the_plain_trie(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ä", "", None])) for c in [*range(60), *range(-12, 0)] for t in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    assert told(spark, rows) == plain(rows)


def test_a_long_conversation_and_a_hot_prefix(spark):
    long = [(5, t, "user", f"t{t}") for t in range(700)]
    hot = [(c, t, "user", "same") for c in range(100, 500) for t in range(10)]
    assert told(spark, long + hot) == plain(long + hot)


def test_ties_nulls_repeats_and_turnless_conversations(spark):
    rows = [(7, None, "user", "z"), (7, None, "user", "a"), (7, None, "user", "a"), (7, 0, None, None), (11, 0, "user", "x"), (None, 0, "user", "lost"), (13, 1, "tool", "€" * 50_000)]
    got = told(spark, rows)
    assert got == plain(rows)
    assert told(spark, [(None, 0, "user", "lost")]) == []


def test_empty_table_and_extra_columns(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, t, "user", f"{t % 2}") for c in range(10, 14) for t in range(3)]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as depth", "3 as mark", "4 as total", "5 as parent")
    assert sorted((tuple(r) for r in prefix_trie(more).collect()), key=repr) == plain(rows)


def test_doubling_sums_a_path_of_any_length(spark):
    n = 300
    key = lambda i: i.to_bytes(16, "big")
    rows = [(key(i), key(i - 1) if i else None, i, 1, i) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node binary, parent binary, depth long, one long, own long")
    got = {int.from_bytes(r.node, "big"): (r.one, r.own) for r in rolled_up(nodes, ["one", "own"], Stash(spark, "test")).collect()}
    assert got == {i: (n - i, sum(range(i, n))) for i in range(n)}


def test_digests_of_long_lists_of_ids(spark):
    ids = list(range(-10, 40_000))
    rows = spark.createDataFrame([(b"k", i) for i in ids] + [(b"l", 3)], "node binary, conv_id long").repartition(5)
    got = {bytes(r.node): r.ends_sha256 for r in list_digests(rows).collect()}
    assert got == {b"k": sha256(",".join(map(str, ids)).encode()).hexdigest(), b"l": sha256(b"3").hexdigest()}
