"""Plain-Python statements of the expected results, for small fixtures only."""

import re
from collections import Counter


def merge(tokens, pair, new):
    """As a substitution over a string with one sign for each token."""
    text = "".join(map(chr, tokens))
    pattern = re.escape("".join(map(chr, pair)))
    return [ord(sign) for sign in re.sub(pattern, chr(new), text)]


def train(chunks, n_merges, first_id, tie="id"):
    """Merges of a chunk sequence (bytes, in corpus order), one pair at a time."""
    state = [list(c) for c in chunks]
    merges = []
    for step in range(n_merges):
        counts = Counter()
        for tokens in state:
            counts.update(zip(tokens, tokens[1:]))
        if not counts:
            break
        if tie == "first":
            pair = max(counts, key=counts.get)
        else:
            pair = min(counts, key=lambda p: (-counts[p], p))
        merges.append((*pair, counts[pair]))
        state = [merge(t, pair, first_id + step) for t in state]
    return merges


def segment(chunk, merges, first_id):
    ranks = {(a, b): first_id + i for i, (a, b, *_) in enumerate(merges)}
    tokens = list(chunk)
    while True:
        known = [ranks[p] for p in zip(tokens, tokens[1:]) if p in ranks]
        if not known:
            return tokens
        best = min(known)
        pair = next(p for p, i in ranks.items() if i == best)
        tokens = merge(tokens, pair, best)
