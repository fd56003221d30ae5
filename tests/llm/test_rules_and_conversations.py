"""Quality rules and conversation repair against plain loops, and on the cases their docstrings define."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF

from gleaner.llm import conversations as cv
from gleaner.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_stop_words": sum(w in qr.STOP_WORDS for w in words)}


def plain_broken(c):
    out = []
    for r in qr.RULES:
        part, whole = 1000 * c[r.part], c[r.whole]
        if (r.least is not None and part < r.least * whole) or (r.most is not None and part > r.most * whole):
            out.append(r.name)
    return ",".join(out)


def test_quality_rules_are_a_plain_loop(spark):
    rnd = random.Random(5)
    odd = [None, "", " \t\n", "a", "a a", "a a a", "a a a a", "x y z x y z", "l\nl\n \n \nl", "日本 語 # | 😀", "\x1c \x1d x", "a\r\nb\rc", "the " * 100_000, "q" * 1_000_000]
    texts = odd + [" ".join(rnd.choice(["the", "ab", "c", "ü#", "dd\n", "e\n"]) for _ in range(rnd.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame([(i // 2, t, "x", True, 1) for i, t in enumerate(texts)], "doc_id long, text string, c string, kept boolean, n_words int").repartition(3)
    want = []
    for i, t in enumerate(texts):
        c = plain_counts(t)
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        want.append((i // 2, *c.values(), base, not base and not plain_broken(c), plain_broken(c)))
    got = qr.quality_rules(docs)
    assert got.columns[:8] == ["doc_id", *c]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = qr.kept_by_rules(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[-2] for w in want)
    assert qr.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_stay_native_and_in_place(spark, tmp_path):
    path = str(tmp_path / "documents")  # of its own: another test may have cached the table
    spark.read.parquet(f"{SF}/documents.parquet").limit(9).write.parquet(path)
    plan = qr.quality_rules(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_quality_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = qr.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in judged if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)
    assert not any(r.kept for r in judged if r.quality == 0)


# conversations


def plain_damage(rows):
    """(all conv_ids, damaged rows) by the contract's words."""
    shown = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return {r[0] for r in rows}, out


def in_order(spark, rows):
    """Rows of one conversation in the docstring's order; the hash of a text only matters beyond 32 equal characters."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:32].encode(), r[3].encode()))


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """All edit sequences with up to len(rows) + 2 inserts, the least (cost, audit) of those that give a legal order."""
    best = None
    states = [(0, "", ())]
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = []
        for cost, audit, turns in states:
            for inserts in range(3):
                for roles in itertools.product(("user", "assistant"), repeat=inserts):
                    c, a, t = cost + 2 * inserts, audit + "I" * inserts, turns + tuple((r, "") for r in roles)
                    after.append((c + 3, a + "D", t))
                    if fault not in ("blank", "duplicate"):
                        more = fault == "truncated"
                        after.append((c + more, a + "K", t + ((role, text),)))
                        after += [(c + 2 + more, a + "R", t + ((r, text),)) for r in ("user", "assistant")]
        states = [s for s in after if re.fullmatch("s?(ua)*u?", "".join(r[:1] if r else "?" for r, _ in s[2]))]
    for cost, audit, turns in states:
        for inserts in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=inserts):
                t = turns + tuple((r, "") for r in roles)
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "?" for r, _ in t)):
                    found = (cost + 2 * inserts, audit + "I" * inserts, t)
                    best = found if best is None else min(best, found)
    return best


def plain_digest(spark, conv, rows):
    rows = in_order(spark, rows)
    faults = plain_faults(rows)
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, repaired = plain_repair(rows, faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


def conversation_rows(seed, convs, most, roles=("system", "user", "user", "assistant", "assistant", "tool", None, "")):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "so on", "", " \t", None, "é… ok.", "x" * 40 + "1.", "x" * 40 + "2.", "Two\nlines."]
    return [(c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(roles), rnd.choice(texts)) for c in [None, *range(convs)] for t in range(rnd.randrange(most))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [10, 1])
def test_repairs_are_brute_force(spark, monkeypatch, bits):
    """Also with stretches of two rows, where nearly every conversation is joined from several."""
    monkeypatch.setattr(cv, "STRETCH_BITS", bits)
    rows = [r for r in conversation_rows(bits, 60, 6) if not (r[3] or "").startswith("xxxx")]
    convs, left = plain_damage(rows)
    want = [plain_digest(spark, c, [r for r in left if r[0] == c]) for c in convs]
    got = cv.repair_digests(cv.damage(spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA + ", audit string, copies int").repartition(3)))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_search_is_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        raw = [(0, i, rnd.choice(["system", "user", "assistant", "tool", ""]), "x") for i in range(rnd.randrange(5))]
        faults = [rnd.choice(["", "", "truncated", "blank"]) for _ in raw]
        rows = [(r[2][:1], f == "blank", f == "truncated", 0) for r, f in zip(raw, faults, strict=True)]
        assert next(iter(cv.search(rows, cv.START, True).values())) == plain_repair(raw, faults)[:2]


def test_stretches_join_to_the_whole():
    rnd = random.Random(4)
    for _ in range(100):
        rows = [(rnd.choice("suaxuaua"), rnd.random() < 0.2, rnd.random() < 0.2, 0) for _ in range(rnd.randrange(1, 40))]
        joined, at = cv.Joined(), 0
        while at < len(rows):
            part = rows[at : at + rnd.randrange(1, 6)]
            joined.add([(b, e, *way) for b in range(4) for e, way in cv.search(part, b, False).items()])
            at += len(part)
        assert joined.best() == next(iter(cv.search(rows, cv.START, True).values()))


def test_repaired_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 5, "user", "u."), (2, 6, "user", "u."), (2, 7, "assistant", "b"), (3, 0, "tool", " ")], SCHEMA)
    got = [tuple(r) for r in cv.repaired_conversations(rows).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, 0, "system", "s.", "K"), (1, 1, None, "user", "", "I"), (1, 2, 1, "assistant", "a.", "K"), (2, 0, 5, "user", "u.", "K"), (2, 1, 7, "assistant", "b", "K")]


def test_one_conversation_of_many_rows(spark):
    """A third of all rows is one row again and again, and long texts pass."""
    n = 9000
    rows = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id, '.') AS text")
    hot = spark.range(n // 2).selectExpr("7L AS conv_id", "-1L AS turn", "'user' AS role", "'same.' AS text")
    long = spark.createDataFrame([(8, 0, "user", "y" * 2_000_000 + "."), (8, 1, "assistant", "z" * 2_000_000)], SCHEMA)
    got = {r.conv_id: r for r in cv.repair_digests(rows.union(hot).union(long)).collect()}
    r = got[7]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (0, 0, n // 2 - 1, 0, n // 2)
    assert r.audit == "K" + "D" * (n // 2 - 1) + "I" + "K" * n and r.cost == 3 * (n // 2 - 1) + 2
    assert got[8].truncated == 1 and got[8].audit == "KK"
    assert cv.repair_digests(rows.limit(0)).count() == 0
