"""Quotation linking against a plain Python version."""

import random
import re

from termloom.llm import quotes


def normal(t):
    return re.sub(r"\s+", " ", t).strip(" ").lower()


def units(t):
    return {normal(x) for x in [t, *re.split(r"\n[ \t]*\n", t)]} - {""}


def parsed(text):
    """(own text, [(level, body)])"""
    lines = []
    for line in re.split(r"\r\n?|\n", text or ""):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        body = line[len(marks) :]
        lines.append((level, re.sub(r"^[ \t]", "", body) if level else line))
    own, passages, last = [], [], 0
    for i, (level, body) in enumerate(lines):
        after = lines[i + 1][0] if i + 1 < len(lines) else 0
        if level == 0 and not (after and re.fullmatch(r"[ \t]*(?:On\b.{1,200}\bwrote|.{1,120}\b(?:wrote|writes|said))[ \t]*:[ \t]*", body)):
            own.append(body)
        if level and level == last and passages:
            passages[-1] = (level, passages[-1][1] + "\n" + body)
        elif level:
            passages.append((level, body))
        last = level
    return "\n".join(own).strip(), passages


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, role or "unknown", *parsed(text)) for c, t, role, text in rows if c == conv]
        first = {}
        for t, _, body, _ in own:
            for u in units(body):
                first[u] = min(t, first.get(u, t))
        parent, linked = {}, {}
        for t, _, _, passages in own:
            found = []
            for level, body in passages:
                at = [first[u] for u in units(body) if u in first and first[u] < t]
                if at:
                    found.append((level, max(at)))
            linked[t] = len(found)
            if found:
                low = min(x[0] for x in found)
                parent[t] = max(x[1] for x in found if x[0] == low)
        placed = []
        for t, role, body, passages in own:
            root, depth = t, 0
            while root in parent:
                root, depth = parent[root], depth + 1
            placed.append((root, t, role, body, depth, len(passages)))
        for k, (root, t, role, body, depth, n) in enumerate(sorted(placed)):
            out.append((conv, k, t, role, parent.get(t), root, depth, n, linked[t], f"<|{role}|>\n{body}"))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "eps"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    rows = []
    for conv in range(40):
        said = []
        for turn in range(rng.randint(1, 14)):
            parts = []
            for _ in range(rng.randint(0, 2)):
                if not said:
                    break
                quoted = rng.choice(said)
                if rng.random() < 0.3:
                    quoted = quoted.split("\n\n")[0].upper().replace(" ", "  ")
                if rng.random() < 0.5:
                    parts.append(rng.choice(["On Monday, X wrote:", "X said:", "so X said: no"]))
                mark = rng.choice([">", "> ", " > "])
                parts += [mark + x for x in re.split("\r?\n", quoted)]
            parts.append("\n\n".join(say() for _ in range(rng.randint(0, 2))))
            text = rng.choice(["\n", "\r\n"]).join(parts)
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "bot", None]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((tuple(r) for r in quotes.reply_ordered(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[8] > 0 for r in got) > 60 and max(r[6] for r in got) > 3


def test_partial_quotes(spark):
    first = "We met on Tuesday to plan the release. The old server will be\nswitched off at the end of March, and all jobs move.\nPlease tell me what you need before that day comes.\n\nThanks to all of you."
    data = [
        (1, 0, "a", first),
        (1, 1, "b", "An unrelated message about quite another matter altogether."),
        (1, 2, "c", "> Please tell me what you need before that day comes.\nTwo days."),
        (1, 3, "d", "> The old server will be switched off at the\n> end of March, and all jobs move.\nFine."),
        (1, 4, "e", "> [...] to plan the release. The old\nGood.\n> you need before that day\nNothing."),
        (1, 5, "f", "> words that nobody in here has ever said\nSo?"),
        (2, 0, "a", "Nothing of the kind."),
        (2, 1, "b", "> Please tell me what you need before that day comes.\nx"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent"], r["depth"], r["n_linked"]) for r in quotes.reply_ordered(df).collect()}
    assert got == {(1, 0): (None, 0, 0), (1, 1): (None, 0, 0), (1, 2): (0, 1, 1), (1, 3): (0, 1, 1), (1, 4): (0, 1, 2), (1, 5): (None, 0, 0), (2, 0): (None, 0, 0), (2, 1): (None, 0, 0)}
