"""The tokenization automaton of a byte-pair vocabulary, compiled into arrays (see bpe_automaton)."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

NEVER = np.int32(2**31 - 1)
#: Groups of fewer words of one length are stepped through word by word.
FEW = 24


class MergeAutomaton:
    """vocab: token -> id, in letters that stand for bytes, ``end`` closing a word; merges in rank order."""

    START = 0

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str], end: str = "</w>"):
        made = {a + b for a, b in merges}
        if len(made) < len(merges):
            raise ValueError("two merges make the same token")
        n = max(vocab.values()) + 1
        self.left, self.rank = [-1] * n, [-1] * n
        self.parent, self.birth, self.lost = [-1], [-1], [{}]
        base = [i for t, i in vocab.items() if t not in made]
        state = [-1] * n  # of each token: where its arcs lead
        for i in base:
            state[i] = self.START
        users = [len(base) + 1]  # the start itself never loses an arc
        for rule, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.left[w], self.rank[w] = u, rule
            if state[u] < 0 or state[v] < 0 or not self._has(state[u], v, rule - 1):
                continue  # an earlier merge always takes u or v away: no path has w
            state[w] = state[v]
            users[state[v]] += 1
            s = state[u]
            if users[s] > 1:
                users[s] -= 1
                self.parent.append(s)
                self.birth.append(rule)
                self.lost.append({})
                users.append(1)
                state[u] = s = len(users) - 1
            self.lost[s][v] = rule
        self._compile(state, len(merges))
        self._label(vocab, letters, end, state)
        del self.parent, self.birth, self.lost, self.left, self.rank

    def _has(self, s: int, t: int, now: int) -> bool:
        """Whether state s has arc t once the rules up to ``now`` are in (while the automaton grows)."""
        while True:
            while self.birth[s] > now:
                s = self.parent[s]
            x, until = s, now
            while x >= 0:
                if self.lost[x].get(t, until + 1) <= until:
                    return False
                until, x = self.birth[x] - 1, self.parent[x]
            if self.rank[t] < 0:
                return True
            now, t = self.rank[t], self.left[t]  # w is where u was when the rule came

    def _compile(self, state: list[int], last: int) -> None:
        """``arcs``: a row of bits for each token, a bit for each state. For every state the rule at which it (or
        what it was split from) lost an arc is known; a token made of u is missing from the start where u was.
        States are numbered so that those split off a state after a rule stand right behind it."""
        size = len(self.parent)
        children: list[list[int]] = [[] for _ in range(size)]
        for s in range(1, size):
            children[self.parent[s]].append(s)  # by birth
        place, stop, todo, at = [0] * size, [0] * size, [0], 0
        while todo:
            s = todo.pop()
            if s < 0:
                stop[~s] = at
                continue
            place[s] = at
            at += 1
            todo.append(~s)
            todo.extend(children[s])  # the youngest is popped first
        lost_at: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(size):
            for v, rule in self.lost[s].items():
                young = next((c for c in children[s] if self.birth[c] > rule), None)  # the oldest of the younger ones
                lost_at.setdefault(v, []).append((rule, place[s], stop[young] if young is not None else place[s] + 1))
        made_of: dict[int, list[int]] = {}
        for w, u in enumerate(self.left):
            if u >= 0 and state[w] >= 0:
                made_of.setdefault(u, []).append(w)
        self.width = (size + 7) // 8
        self.arcs = np.zeros((len(state), self.width), dtype=np.uint8)
        todo2 = [(t, None) for t in range(len(state)) if self.left[t] < 0 and state[t] >= 0]
        while todo2:
            t, above = todo2.pop()
            gone = np.full(size, NEVER, dtype=np.int32)
            for rule, a, z in sorted(lost_at.get(t, ()), reverse=True):
                gone[a:z] = np.minimum(gone[a:z], rule)
            if above is not None:
                gone[above <= self.rank[t]] = -1
            self.arcs[t] = np.packbits(gone > last, bitorder="little")
            todo2.extend((w, gone) for w in made_of.get(t, ()))
        self.arcs = self.arcs.ravel()
        where = np.array(place, dtype=np.int32)
        self.state = np.array([where[s] if s >= 0 else -1 for s in state], dtype=np.int32)

    def _label(self, vocab: dict[str, int], letters: list[str], end: str, state: list[int]) -> None:
        """The trie of labels over bytes and, beyond 255, bytes that close a word: edges as sorted numbers
        node * 512 + byte with the node they lead to; ``token`` of a node, -1 where it has none; whether it goes on."""
        byte = {c: i for i, c in enumerate(letters)}
        edges: dict[int, int] = {}
        tokens = [-1]
        for t, i in vocab.items():
            if state[i] < 0:
                continue
            closed = t.endswith(end)
            spelled = t[: -len(end)] if closed else t
            node = 0
            for k, c in enumerate(spelled, 1):
                edge = node * 512 + byte[c] + 256 * (closed and k == len(spelled))
                if edge not in edges:
                    edges[edge] = len(tokens)
                    tokens.append(-1)
                node = edges[edge]
            if node:
                tokens[node] = i
        order = sorted(edges)
        self.edges = np.array(order, dtype=np.int32)
        self.to = np.array([edges[e] for e in order], dtype=np.int32)
        self.token = np.array(tokens, dtype=np.int32)
        self.goes_on = np.zeros(len(tokens), dtype=bool)
        self.goes_on[self.edges // 512] = True

    def follow(self, node, code):
        """The nodes that edges lead to, -1 where there is none (int32 arrays)."""
        edge = node * np.int32(512) + code
        at = np.searchsorted(self.edges, edge)
        at[at == len(self.edges)] = 0
        return np.where(self.edges[at] == edge, self.to[at], np.int32(-1))

    def arc(self, s, t):
        """Whether states s have arcs t (numbers or arrays)."""
        return self.arcs[t * self.width + (s >> 3)] >> (s & 7) & 1

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word, given in bytes."""
        n = len(word)
        codes = [*word[:-1], word[-1] + 256] if n else []
        reached, back = [-1] * (n + 1), [(0, 0)] * (n + 1)
        reached[0] = self.START
        token, state, arcs, width, goes_on, to = self.token.item, self.state.item, self.arcs.item, self.width, self.goes_on.item, self.to.item
        edges = memoryview(self.edges)
        for i in range(n):
            s, node, j = reached[i], 0, i
            if s < 0:
                raise ValueError(f"no symbol for {word[i - 1 : i]!r}")
            while j < n and goes_on(node):
                edge = node * 512 + codes[j]
                at = bisect_left(edges, edge)
                if at == len(edges) or edges[at] != edge:
                    break
                node, j = to(at), j + 1
                t = token(node)
                if t >= 0 and arcs(t * width + (s >> 3)) >> (s & 7) & 1:
                    reached[j], back[j] = state(t), (i, t)
        if reached[n] < 0:
            raise ValueError(f"no path spells {word!r}")
        out, j = [], n
        while j:
            j, t = back[j]
            out.append(t)
        return out[::-1]

    def encode_words(self, words: list[bytes], kind) -> list[bytes]:
        """Ids of each word as bytes of numbers of ``kind``. Words of one length step through the tables side by
        side."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1)).tolist()
        for a, z in zip(cuts, cuts[1:], strict=False):
            for low in range(a, z, 1 << 15):
                group = order[low : min(z, low + (1 << 15))]
                n = int(sizes[group[0]])
                if not n:
                    continue
                if len(group) < FEW or n > 200:
                    for k in group.tolist():
                        out[k] = np.array(self.encode(words[k]), dtype=kind).tobytes()
                    continue
                codes = flat[starts[group] + np.arange(n)[:, None]].astype(np.int32)
                codes[-1] += 256
                ids, counts = self._side_by_side(codes)
                raw, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                ends = (np.cumsum(counts) * size).tolist()
                for k, x, y in zip(group.tolist(), [0, *ends], ends, strict=False):
                    out[k] = raw[x:y]
        return out

    def _side_by_side(self, codes):
        """codes (letter, word) -> ids of all words, one after another, and how many each has."""
        n, m = codes.shape
        reached = np.full((n + 1, m), -1, dtype=np.int32)
        token, origin = np.zeros((n + 1, m), dtype=np.int32), np.zeros((n + 1, m), dtype=np.int32)
        reached[0] = self.START
        for i in range(n):
            at = np.flatnonzero(reached[i] >= 0)
            s, node = reached[i][at], np.zeros(len(at), dtype=np.int32)
            for j in range(i, n):
                node = self.follow(node, codes[j][at])
                on = node >= 0
                if not on.all():
                    at, s, node = at[on], s[on], node[on]
                t = self.token[node]
                ok = t >= 0
                ok[ok] = self.arc(s[ok].astype(np.int64), t[ok].astype(np.int64)) > 0
                to, t = at[ok], t[ok]
                reached[j + 1][to], token[j + 1][to], origin[j + 1][to] = self.state[t], t, i
                on = self.goes_on[node]
                if not on.all():
                    at, s, node = at[on], s[on], node[on]
                if not len(at):
                    break
        if (reached[n] < 0).any():
            raise ValueError("no path spells a word")
        # Back from the ends; the last column is the last token.
        out, counts = np.full((m, n), -1, dtype=np.int32), np.zeros(m, dtype=np.int64)
        at, place = np.arange(m), np.full(m, n)
        column = n
        while len(at):
            column -= 1
            out[at, column] = token[place, at]
            counts[at] += 1
            place = origin[place, at]
            on = place > 0
            at, place = at[on], place[on]
        return out[out >= 0], counts
