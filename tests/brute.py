"""Row-by-row second opinion in plain Python, for small collections."""

import math
import re


def tokens(text):
    return re.findall(r"[0-9a-z]+", (text or "").lower())


def statistics(docs, vocabulary):
    df = dict.fromkeys(vocabulary, 0)
    cf = dict.fromkeys(vocabulary, 0)
    length = 0
    for _, text in docs:
        found = tokens(text)
        length += len(found)
        for term in vocabulary:
            n = found.count(term)
            cf[term] += n
            df[term] += n > 0
    return len(docs), length, df, cf


def score(model, topic, text, n_docs, length):
    """``topic``: list of (term, qtf, df, cf)."""
    found = tokens(text)
    dl = len(found)
    if dl == 0:
        return 0.0
    rows = [(found.count(term), qtf, df, cf) for term, qtf, df, cf in topic]
    if model.startswith("LMs"):
        weight = float(model[3:])
        total = sum(
            qtf * math.log(1 + tf * length * weight / (cf * dl * (1 - weight)))
            for tf, qtf, df, cf in rows
            if tf
        )
        return total + math.log(dl) if total > 0 else 0.0
    if model == "LMdi":
        total = sum(
            qtf * (math.log(tf * (length // cf) + 2500) - math.log(dl + 2500))
            for tf, qtf, df, cf in rows
        )
        return max(total, 0.0)
    if model == "BM25":
        k = 1.2 * (0.25 + 0.75 * dl / (length / n_docs))
        return sum(
            qtf * 2.2 * tf / (k + tf) * math.log((n_docs - df + 0.5) / (df + 0.5))
            for tf, qtf, df, cf in rows
            if tf
        )
    product = 1.0
    for tf, qtf, _, _ in rows:
        if not tf:
            return 0.0
        product *= (tf / dl) ** qtf
    return product * dl


def run(model, topics, docs, n_docs, length):
    """``{qid: {doc_id: sorted scores}}`` of all pairs with a score."""
    out = {}
    for qid, topic in topics.items():
        for doc_id, text in docs:
            s = score(model, topic, text, n_docs, length)
            if s != 0.0:
                out.setdefault(qid, []).append((doc_id, s))
    return {qid: sorted(rows) for qid, rows in out.items()}
