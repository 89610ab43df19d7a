"""Small corpora with the odd cases that every operator must take, and plain definitions to hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(n=40, seed=5):
    """Rows with copies, near copies, shared passages, null and empty texts, odd spaces and one long text."""
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdefgéñü") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["the", "of", "and", "la", "The", "OF"]
    passage = " ".join(rng.choice(bag) for _ in range(70))
    texts = [" ".join(rng.choice(bag) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    for i in range(0, n, 7):
        texts.append(texts[i])
        changed = texts[i].split(" ")
        changed[len(changed) // 2] = "changed"
        texts.append(" ".join(changed))
        texts.append(f"{texts[i][:80]} {passage} {texts[i][80:]}")
    texts += [None, "", " ", "\n\n", "a  b\t c\x0bd\r\n", "x <|endoftext|> y", "日本語 テキスト ՘ ﬁ", "o " * 4000, "Ünï " + "code" * 500, "\0nul \x1c sep"]
    rows = [(i * 3 + 1, t, "en", [None, "b", "a", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, texts[3], "en", "a", 1), (None, None, None, None, None)]
