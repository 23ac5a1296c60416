"""Small tables and plain-Python counterparts for the operators' tests."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Plain, repeated, near-copied, junk, empty, null and long texts; repeated rows; null ids and sources."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 150).split()
    for k in range(12):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "   \n\t ", "one", "One two", "one two", "a b c d e " * 30,
              "line one\nline one\n\nline two\nline one", "### $$$ %%% <b> & |", prose(rng, 6000), "café Été ΣΣ \U0001f600 ok   x"]
    rows = [(i, t, "en", [None, "a", "b", "é", "hot"][min(4, rng.randrange(8))], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "a text without an id", "en", "a", 20), (None, None, None, None, None)]


def reach(ids, links):
    """Smallest id reachable by links, of each id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
