"""Chat repair against an exhaustive search over all legal outcomes."""

import itertools
import random
from collections import defaultdict

import pytest

from reviewlake.llm import chat_format as chat

REPAIR = chat.Repair()


def cheapest(roles):
    """Least price over all choices, tried one by one."""
    p = chat.Prices()

    def go(i, state):
        if i == len(roles):
            return REPAIR.end_price(state)
        role, best = roles[i], chat.NEVER

        def label(s):
            return 0 if chat.ROLES[s] == role else p.relabel if role in chat.ROLES[1:] else p.unknown

        if state:
            best = p.merge + label(state) + go(i + 1, state)
        for inserted in range(3):
            for path in itertools.product((1, 2, 3), repeat=inserted + 1):
                if all(b in chat.MOVES[a] for a, b in zip((state, *path), path)):
                    best = min(best, p.insert * inserted + label(path[-1]) + go(i + 1, path[-1]))
        return best

    return go(0, chat.START)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "User ", "tool", None])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, rng.choice(["", "hi", None, "x\ny"]), "clash"))
    rows += [(None, 1, "assistant", "a", "c"), (None, 0, None, None, None), rows[0]]
    rows += [(999, i, rng.choice(["user", "assistant", "system"]), f"t{i}", None) for i in range(700)]  # one long conversation
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, position string"


def test_repair(spark, turns):
    frame = spark.createDataFrame(turns, SCHEMA).repartition(8)
    found = chat.format_chats(frame).collect()
    assert len(found) == len(turns)
    by_conv = defaultdict(list)
    for r in found:
        by_conv[r.conv_id].append(r)
    for rows in by_conv.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        keys = [(r.turn is not None, r.turn or 0) for r in rows]
        assert keys == sorted(keys)
        roles = [chat.Repair.role(r.role) for r in rows]
        if len(roles) < 6:
            assert sum(r.price for r in rows) == cheapest(roles)
        text = "".join(r.rendered for r in rows)
        shown = [x.split("|>\n")[0] for x in text.split("<|end|>\n") if x]
        state = chat.START
        for name in shown:
            step = chat.ROLES.index(name.removeprefix("<|"))
            assert step in chat.MOVES[state]
            state = step
        assert state in chat.FINAL
    long = by_conv[999]
    total = REPAIR.total([r.role for r in long])[chat.START]
    assert sum(r.price for r in long) == min(total[s] + REPAIR.end_price(s) for s in range(4))


def test_one_conversation_over_many_ranges(spark, turns):
    frame = spark.createDataFrame(turns, SCHEMA).filter("conv_id = 999")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = chat._ranges(frame.select("conv_id", "turn", "role", "text"))
        assert len(chat._edges(ranges, REPAIR)) > 1
        found = sorted(chat.format_chats(frame).collect(), key=lambda r: r.position)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = REPAIR.total([r.role for r in found])[chat.START]
    assert sum(r.price for r in found) == min(total[s] + REPAIR.end_price(s) for s in range(4))
    assert [r.turn for r in found] == list(range(700)) and [r.position for r in found] == list(range(700))


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
