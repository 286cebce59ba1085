import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, _id string, kept string"


def words(r, n, alphabet="abcdefghij"):
    return [r.choice(alphabet) + r.choice(alphabet) + r.choice(alphabet) for _ in range(n)]


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice("xyz") * 3
    return " ".join(w)


def nasty_rows(seed=1):
    """Nulls in every column, empty and blank texts, long ones, ties, repeated rows, near and exact copies, a hot group."""
    r = random.Random(seed)
    texts = [" ".join(words(r, r.randrange(1, 60))) for _ in range(60)]
    texts += [None, None, "", " \n\t", "a", "a", "A", "one two", "one  two", "é ü ß", "1 2 3", "...", "x" * 20_000, " ".join(words(r, 6000))]
    base = " ".join(words(r, 80))
    texts += [base] * 12 + [base.replace(" ", "\n", 3) for _ in range(4)] + [base.upper()]
    texts += [edited(r, base, k % 7) for k in range(30)]
    texts += [edited(r, texts[i], 1) for i in range(20)]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None, "é", ""]), None if i % 9 == 0 else len(t or ""), 7, "clash", "clash", "clash"))
    out += [out[5], out[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


#: Labels with nulls, unknown ids and repeated rows.
LABELS = [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (99999, 1, 1), (5, 1, 0)]
