from tracewell.llm import replies

TASK = "Task: load the plan of a ledger and update what depends on it.\n\nRequirements in force:\n- RQ-0000001: Nobody should move the ledger while the queue is open.\n\nSource files you may name:\n- src/a/plan.ts\n- src/b/list.ts\n\nAnswer with JSON."
GOOD = [
    '{"affected_files": [], "violated_requirements": [], "rationale": "Nothing depends on it."}',
    'We move the plan first.\n\n```json\n{"affected_files": ["src/a/plan.ts"], "rationale": "The queue is still open."}\n```',
    "Task: load the plan of a ledger and update what depends on it.\n\nThe queue must be closed before the plan is moved.\n- src/a/plan.ts\n- RQ-0000001",
    '{"affected_files": ["src/a/plan.ts"], "rationale": "The title “Aufbewahrung der Nachweise” is kept as it stands."}',
    '{"affected_files": ["src/a/plan.ts"], "rationale": "I cannot see a direct import of it, yet the closure still reaches it. Sorry for the long list."}',
    "Editors are not allowed to write there, so an admin has to approve it.",
]
BAD = {
    "empty": [None, "", " \n", "​\n", "```json\n```", "[]", '{""}', " \t"],
    "truncated": ['{"affected_files": ["src/a/pl', '```json\n{"rationale": "The queue', "The queue must be closed before the pl", "The queue is open.\n- src/a/plan.ts\n- src/b/li", "The queue is open.\n- RQ-", '{"a": ["b"], "rationale": "It is open."'],
    "refusal": ["I'm sorry, but I can’t help with that request.", '{"affected_files": [], "rationale": "I must decline to evaluate this."}', "```\nLo siento, no puedo ayudar con esa petición.\n```", "je suis désolé, je ne peux pas vous aider avec cette demande. adressez-vous au responsable.", '{"error": "This request goes against my guidelines, so I will not answer it."}'],
    "copied_prompt": [TASK, TASK.upper(), " ".join(TASK.split()), "```\n" + TASK + "\n```", "> " + TASK.replace("\n", "\n> "), TASK[: int(len(TASK) * 0.8)]],
    "other_language": ['{"affected_files": ["src/a/plan.ts"], "rationale": "Ohne die Rolle darf niemand in diesem Ordner schreiben."}', "Без этой роли никто не может писать в эту папку.\n- src/a/plan.ts", "没有这个角色的人不能写入这个目录。", "Senza il ruolo nessuno può scrivere in questa cartella."],
}


def test_pairs():
    for reply in GOOD:
        assert replies.defect(TASK, reply) is None, reply
    for kind, found in BAD.items():
        for reply in found:
            assert replies.defect(TASK, reply) == kind, reply
    assert replies.defect(None, "The queue is open.") is None
    assert replies.defect("", "Ohne die Rolle darf niemand schreiben.") is None
    assert replies.defect("Aufgabe: Ändere die Spalte und passe alle abhängigen Stellen an.", "Each row must keep its value for as long as the audit is open.") == "other_language"


def test_refusal_in_a_long_sentence():
    clause = "While the ledger and its queue were moved last night and each of the reviewers said that the plan is still the one which was agreed on before the audit had begun and that nobody has to wait, "
    for said in ("I cannot answer this", "I must decline", "answering this is outside of what I'm allowed to do"):
        assert replies.defect(TASK, clause + said + ".") == "refusal"
        assert replies.defect(TASK, said + " " + clause + "as it was.") == "refusal"
    spread_out = "I see that the plan cannot be read by all, so each editor has to answer for what he did in this"
    assert replies.defect(TASK, spread_out + ".") is None


def test_lcs_against_quadratic():
    import random

    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], max(row[j], row[j - 1], prev + (x == y))
        assert replies.lcs(a, b) == row[-1]


SCHEMA = "reply_id long, prompt string, raw_response string, replied_at timestamp, parse_error string, defect string"


def test_operator(spark):
    from datetime import datetime

    t, u = datetime(2024, 1, 1), datetime(2024, 1, 2)
    long = "The queue must be closed before the plan is moved. " * 40_000
    rows = [(1, TASK, GOOD[0], t), (1, TASK, "", u), (2, TASK, "", t), (2, TASK, GOOD[0], u), (3, None, None, None), (4, TASK, long, t), (5, TASK, long + "The qu", t), (None, TASK, "", t), (3, None, None, None)]
    df = replies.defective_pairs(spark.createDataFrame([(*r, "e", "d") for r in rows], SCHEMA))
    assert sorted((r.reply_id, r.defect) for r in df.collect()) == [(1, "empty"), (3, "empty"), (5, "truncated")]
    assert replies.defective_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
