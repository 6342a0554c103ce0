"""Plain, slow versions of the operators that SQL cannot express."""

from __future__ import annotations

import hashlib
import re

OP4_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WS_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub(r"[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def leaks(docs, items, window=10):
    grams: dict[tuple, set] = {}
    for item_id, text in items:
        words = OP4_WORDS.findall(lower_ascii(text or ""))
        if words:
            n = min(window, len(words))
            for j in range(len(words) - n + 1):
                grams.setdefault(tuple(words[j:j + n]), set()).add(item_id)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        words = OP4_WORDS.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if ids := grams.get(tuple(words[i:i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def repetition(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat."""
    text = text or ""
    words = WS_WORDS.findall(text)
    lines = [x for x in text.split("\n") if WS_WORDS.search(x)]
    n = len(words)

    def covered(k):
        seen: dict[tuple, list] = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i:i + k]), []).append(i)
        return {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(k)}

    longest = 0
    for k in range(5, n):
        if not covered(k):
            break
        longest = k
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered(5)),
            len(covered(10)), longest)
