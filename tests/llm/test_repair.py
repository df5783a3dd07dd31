import hashlib
import heapq
import random
import re
import zlib

from cairn.llm import repair

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies int"


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, texts) by a search over whole edit sequences, cheapest first and then by letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for x, role in (("u", "user"), ("a", "assistant")):
            if x in nexts:
                heapq.heappush(heap, (cost + 3, audit + "I", i, x, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in (1, 2):
                late = 3 * (fault == 3)
                if role[:1] and role[:1] in nexts:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in nexts:
                        heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, x, (*out, (name, text))))
    raise AssertionError


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in harmed(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            solid = text.strip(WHITE)
            faulty.append((role, text, 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, texts = cheapest(faulty)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in texts).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f[2] == k for f in faulty) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(seed, conversations, longest):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ünknown"])
            text = rng.choice(["Yes.", "No!", "cut", "Is it? ", "", " \n", None, f"t{rng.random()}.", f"t{rng.random()}"])
            out.append((c, rng.choice([t, t, t, t, 2 * t, None, -t]), role, text))
    return out + [(None, 0, "user", "Hm."), (None, None, "assistant", "x"), (None, 1, "assistant", "Ok.")] + [(90, 5, "user", "Same.")] * 7 + [(91, t, "user" if t % 2 == 0 else "assistant", "word. " * 9000) for t in range(4)]


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, repair.report(repair.repair(repair.damage(df), repair.F.col("copies"))).collect()), key=str)


def test_matches_brute_force(spark):
    rows = rows_of(1, 60, 12)
    assert run(spark, rows) == brute(rows)


def test_long_conversations_are_cut_into_blocks(spark):
    """Conversations over many ranges: blocks are chained and traced apart."""
    rows = rows_of(2, 3, 120)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
        pieces = repair.repair(repair.damage(df), repair.F.col("copies"))
        assert max(r.pieces for r in pieces.collect()) > 3
        assert sorted(map(tuple, repair.report(pieces).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_compose_as_one_scan(monkeypatch):
    """Small blocks within one range give what one block gives."""
    rng = random.Random(4)
    automaton = repair.Automaton.complete()
    rows = [(rng.choice([1, 1, 3]), "r", "t", rng.randrange(9)) for _ in range(60)]
    moves, state, cost = repair.scan(automaton, rows)
    audit, out, _ = repair.trace(rows, moves, repair.START, True)
    cuts = [0, 7, 7, 30, 60]
    behind, total, q, parts = repair.Automaton.END, 0, repair.START, []
    tables = [repair.table_of(automaton, rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    states = []
    for before, costs, _ in reversed(tables):
        states.append(behind)
        total, behind = total + costs[behind], before[behind]
    assert (behind, total) == (state, cost)
    for (a, b), s, (_, _, leads) in zip(zip(cuts, cuts[1:], strict=False), reversed(states), tables, strict=True):
        piece, _, after = repair.trace(rows[a:b], repair.scan(automaton, rows[a:b], s)[0], q, False)
        assert after == leads[4 * s + q]
        parts.append(piece)
        q = after
    assert audit == "".join(parts) + repair.LAST_LETTERS[q]


def test_undamaged_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")], "conv_id long, turn long, role string, text string")
    got = repair.repair(df).collect()
    assert [(r.conv_id, r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in got] == [(1, 0, "KKK", [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello.")])]
    assert repair.report(repair.repair(df.limit(0))).count() == 0
