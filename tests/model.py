"""A plain sequential model of description matching and batch decisions."""

import re
import unicodedata


def normalize(text):
    upper = unicodedata.normalize("NFKD", text).upper()
    return "".join(
        c for c in upper if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"
    )


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def match(a, b):
    na, nb = normalize(a), normalize(b)
    if na == nb:
        return True
    if re.findall(r"\d+", a) != re.findall(r"\d+", b) or min(len(na), len(nb)) < 8:
        return False
    return 1 - distance(na, nb) / max(len(na), len(nb)) >= 0.9


def decide(rows, stored):
    """rows: (pos, description, allow) in order -> ({pos: preview reason}, {pos: outcome})."""
    reasons, outcomes, seen, accepted = {}, {}, [], []
    for pos, text, allow in rows:
        existing = any(match(text, d) for d in stored)
        in_batch = any(match(text, d) for d in seen)
        reasons[pos] = "EXISTING_TRANSACTION" if existing else "IN_BATCH" if in_batch else None
        seen.append(text)
        duplicate = existing or any(match(text, d) for d in accepted)
        if duplicate and not allow:
            outcomes[pos] = "SKIP"
        else:
            outcomes[pos] = "DUPIMP" if duplicate else "NEW"
            accepted.append(text)
    return reasons, outcomes
