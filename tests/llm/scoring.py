"""The area under the curve of (score, label) pairs."""


def auc(pairs):
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
