import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "Ünïcode space   x\x1cy", "don't <|endoftext|> it's", "  two  spaces  \n\n tab\t\tend ", "日本語 текст 123 45.6", "x" * 3000, "a b c " * 900, "Á é <|startoftext|>z", "#*$%&|<> <a> & b"]


def odd_documents(n=60, seed=3):
    """(doc_id, text, lang, source): odd texts, copies and random ones."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "über", "niño", "cat's", "Dog", "runs,", "42", "x.y", *(f"tok{i}" for i in range(300))]
    out = [(i, t, "en", "src0") for i, t in enumerate(ODD_TEXTS)]
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 150))]
        out.append((100 + i, "".join(w + r.choice([" ", " ", "\n", "  "]) for w in words), r.choice(["en", "de", None]), r.choice(["src0", "src1", None])))
    out += [(300 + i, out[20][1], "en", "src0") for i in range(25)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"
