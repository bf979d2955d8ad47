"""Conversation repair: the search against all edit strings, the operator against its SQL, odd tables."""

import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

from phasegrid.llm import repair
from phasegrid.llm.queries import ORACLE

ROWS = "conv_id long, turn long, role string, text string, cost long, audit string, place int"


def tried(rows):
    """(cost, audit) over every edit string with at most two inserts, by the wording of the rules."""
    found = []
    for letters in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(rows)):
        for added in ([], *([g] for g in itertools.product(range(len(rows) + 1), "ua")), *itertools.combinations_with_replacement(list(itertools.product(range(len(rows) + 1), "ua")), 2)):
            cost, out, audit = 0, [], []
            for k in range(len(rows) + 1):
                for at, role in added:
                    if at == k:
                        out.append(role)
                        audit.append("I")
                        cost += 5
                if k == len(rows):
                    break
                role, fault = "sua?"[rows[k] & 3], rows[k] >> 2
                if letters[k] != "D" and fault in (repair.BLANK, repair.DUPLICATE):
                    cost = None
                    break
                audit.append(letters[k][0])
                cost += {"D": 2, "K": 0, "R": 1}[letters[k][0]] + (5 if letters[k] != "D" and fault == repair.CUT else 0)
                if letters[k] != "D":
                    out.append(role if letters[k] == "K" else letters[k][1])
            if cost is not None and re.fullmatch(r"(s?(ua)+)?", "".join(out)):
                found.append((cost, "".join(audit)))
    return min(found)


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_all_edit_strings(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = bytes(rng.randrange(4) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(5)))
        assert repair.repair(rows) == tried(rows)


def test_search_needs_time_in_proportion_to_the_rows():
    rng = random.Random(5)
    rows = bytes(rng.choice([0, 1, 2, 1, 2, 3]) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(60_000))
    cost, audit = repair.repair(rows)
    assert cost == repair.suffix_bounds(rows)[0][repair.OPEN] and len(audit) - audit.count("I") == len(rows)


def odd_rows():
    said = [None, "", " \t\n", "Fine.", "cut", "Fine. ", "ends? ", "a!\x0b", "ünï.", "x" * 50_000 + "."]
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, None, 0, -3]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(said)))
    return rows + rows[:10] + [(7, 1, "user", "same.")] * 3 + [(None, k, "user", "no id.") for k in range(6)]


def test_operator_equals_its_sql_on_odd_rows(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS).repartition(5)
    got = repair.repair_conversations(repair.damaged(frame), there="there").collect()
    con = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM conversations")
    want = con.execute(ORACLE["op11_conversation_repair"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["duplicate"] for r in got) > 0 and sum(r["truncated"] for r in got) > 0 and sum(r["conv_id"] is None for r in got) == 1


def test_texts_empty_table_and_all_dropped(spark):
    frame = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (2, 0, "user", "cut"), (3, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    got = {r["conv_id"]: r for r in repair.repair_conversations(frame, texts=True).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[1]["illegal"]) == (1, "KKR", 1)
    assert [tuple(x) for x in got[1]["repaired"]] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello.")]
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Hello.").hexdigest()
    assert got[2]["audit"] == "D" and got[2]["truncated"] == 1 and got[3]["blank"] == 1 and got[3]["gaps"] == 0
    gone = repair.repair_conversations(frame.selectExpr("*", "false as there"), there="there").collect()
    assert {(r["cost"], r["audit"], r["repaired_sha256"]) for r in gone} == {(0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 3
    assert repair.repair_conversations(frame.where("false")).count() == 0
