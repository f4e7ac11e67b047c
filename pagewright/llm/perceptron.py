"""An averaged perceptron over sparse string features."""

from __future__ import annotations

from collections import defaultdict


class AveragedPerceptron:
    """Multi-class; every example brings its own set of possible labels."""

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self._sums: dict = defaultdict(lambda: defaultdict(float))
        self._steps = 0

    def scores(self, features, labels) -> dict[str, float]:
        out = dict.fromkeys(labels, 0.0)
        for f in features:
            w = self.weights.get(f)
            if w:
                for label in out:
                    v = w.get(label)
                    if v:
                        out[label] += v
        return out

    def best(self, features, labels) -> str:
        """The label of the highest score; the first of equal ones."""
        s = self.scores(features, labels)
        return max(labels, key=s.__getitem__)

    def learn(self, features, labels, truth: str) -> None:
        self._steps += 1
        s = self.scores(features, labels)
        rival = max((x for x in labels if x != truth), key=lambda x: (s[x], x))
        if s[rival] >= s[truth]:  # a tie is a mistake too
            for f in features:
                w, total = self.weights.setdefault(f, {}), self._sums[f]
                for label, d in ((truth, 1.0), (rival, -1.0)):
                    w[label] = w.get(label, 0.0) + d
                    total[label] += d * self._steps

    def finish(self) -> AveragedPerceptron:
        """Replace every weight by its mean over all steps."""
        for f, w in self.weights.items():
            for label in w:
                w[label] -= self._sums[f][label] / max(1, self._steps)
        self._sums.clear()
        return self
