import hashlib
import random
import re
import zlib

from loomwork.llm import chat


def show(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for role, text in turns:
        begin = at + len(f"<|{role}|>\n")
        at = begin + len(text) + len("<|end|>\n")
        if role == "assistant":
            out.append((begin, at))
    return out


def test_preferences(spark):
    r = random.Random(1)
    say = lambda: [(r.choice(["user", "assistant", "system"]), r.choice(["", "a b", "é.", "x\ny"])) for _ in range(r.randint(0, 6))]
    pairs = []
    for k in range(200):
        a = say()
        pairs.append((k, a, a[: r.randint(0, len(a))] + say()))
    pairs += [(200, None, [("user", "a")]), (201, None, None), (201, None, None), (202, [("user", "q"), ("assistant", None)], [("user", "q")])]
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    got = chat.preferences(spark.createDataFrame([(*p, "old") for p in pairs], kind)).collect()
    want = {}
    for k, a, b in pairs:
        a, b, n = ([(role, text or "") for role, text in x or []] for x in (a, b)), None, 0
        a, b = a
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        want[k] = (n, show(a[:n]), show(a[n:]), show(b[n:]), spans(a[n:]), spans(b[n:]))
    assert len(got) == len(pairs)
    for x in got:
        assert (x.prefix_turns, x.prompt, x.chosen, x.rejected, [tuple(s) for s in x.chosen_mask], [tuple(s) for s in x.rejected_mask]) == want[x.pair_id]


def test_whole_table(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "Long. Reply."), (1, 2, "user", "r"), (1, 3, "assistant", "End"), (2, 0, "user", "alone"), (None, 0, "user", "lost"), (3, 1, "assistant", "b"), (3, 0, None, None), (3, 1, "assistant", "b"), (4, None, "assistant", "x")]
    table = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {x.pair_id: x for x in chat.shortened_pairs(table).collect()}
    assert sorted(got) == [1, 3, 4]
    assert [tuple(t) for t in got[3].chosen] == [("user", ""), ("assistant", "b")]
    at = [1, 3][zlib.crc32(b"1") % 2]
    whole = [(a, b) for _, _, a, b in rows[:4]]
    assert [tuple(t) for t in got[1].rejected] == whole[:at] + [("assistant", re.match(r"[^.]*\.?", whole[at][1]).group())]
    assert chat.preferences(chat.shortened_pairs(table.limit(0))).collect() == []
    assert len(hashlib.sha256(b"").hexdigest()) == 64
