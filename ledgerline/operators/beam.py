"""Beam search over the readings of noisy amounts and balances, one row of many statements at a time, on arrays.

Rows come sorted by statement. Statements of a batch are read side by side; one that goes on in the next batch takes its
beam along and the rows its paths don't agree on yet, never all of its rows. Money is integer cents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNREADABLE, BROKEN, SUFFIX, IMPLIED = 50_000_000, 10_000_000, 500, 1000  # costs in ten-thousandths
#: Rows read side by side, cells of a table compared at once, and cents beyond which sums might not fit.
AT_ONCE, CELLS, LARGEST = 4096, 4_000_000, 2**62
TENS = 10 ** np.arange(19)


def _spread(starts, counts):
    """starts[k], starts[k] + 1, ... (counts[k] of them) one after the other, and the k of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(which)) + (starts - np.cumsum(counts) + counts)[which], which


def _table(values, starts, counts, fill, width=None):
    """A line for each start, filled up to the longest or to a width; and which cells are values."""
    k = np.arange(width or counts.max(initial=1))
    inside = k < counts[:, None]
    return np.where(inside, values[np.where(inside, starts[:, None] + k, 0)], fill), inside


def _flat(lists):
    """Values of an array column, one more for empty lists to point at, and each row's start and number."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 0), np.cumsum(n) - n, n


class Cells:
    """Candidates and digits of a batch's rows, flat."""

    def __init__(self, batch):
        rows = np.arange(len(batch))
        self.amounts, self.a_at, self.a_n = _flat(batch.column("amounts"))
        self.balances, self.b_at, self.b_n = _flat(batch.column("balances"))
        # balances by row and number of digits (three at least, as they are shown), with their ranks
        row, b = np.repeat(rows, self.b_n), self.balances[:-1]
        length = np.maximum(np.searchsorted(TENS, b, "right"), 3)
        order = np.lexsort((length, row))
        self.by_length, self.rank = np.append(b[order], 0), (np.arange(len(b)) - self.b_at[row])[order]
        self.length_n = np.bincount(20 * row + length, minlength=20 * len(rows)).reshape(-1, 20)
        self.length_at = (np.cumsum(self.length_n) - self.length_n.ravel()).reshape(-1, 20)
        # places stand before, between and after a row's digits; ``before`` has the place to the left of the last such digit
        texts = [(t or "").encode() for t in batch.column("raw").to_pylist()]
        text, owner = np.frombuffer(b"".join(texts), np.uint8), np.repeat(rows, [len(t) for t in texts])
        self.signs = np.stack([np.bincount(owner[text == ord(c)], minlength=len(rows)) > 0 for c in "+-"])
        is_digit = (text >= ord("0")) & (text <= ord("9"))
        digit, owner = text[is_digit] - ord("0"), owner[is_digit]
        n, k = np.bincount(owner, minlength=len(rows)), np.arange(len(digit))
        start = np.cumsum(n) - n
        self.before, self.end = np.full((len(digit) + len(rows), 10), -1, np.int32), start + rows + n
        for d in range(10):
            last = np.maximum.accumulate(np.where(digit == d, k, -1))
            self.before[k + owner + 1, d] = np.where(last >= start[owner], last + owner, -1)

    def shown(self, row, amount):
        """Whether a row's amount cell shows an amount: its sign and, in order, its digits."""
        found = np.zeros(len(row), bool)
        live = np.flatnonzero(self.signs[(amount < 0).astype(int), row])
        rest, place, n = np.abs(amount[live]), self.end[row[live]], 0
        while len(live):
            tens = rest // 10
            place, rest, n = self.before[place, rest - 10 * tens], tens, n + 1
            done = (place >= 0) & (rest == 0) & (n >= 3)
            found[live[done]] = True
            on = (place >= 0) & ~done
            live, rest, place = live[on], rest[on], place[on]
        return found


# options: (pair, cost, turn, amount, balance), a pair being a row and a balance before it; equal costs go by turn
def _linked(cells, row, previous):
    """Amounts that lead to a balance or to a figure that a balance ends; balances whose difference the amount cell shows."""
    amounts, inside = _table(cells.amounts, cells.a_at[row], np.minimum(cells.a_n[row], 40), 0)
    width = amounts.shape[1]
    want = previous[:, None] + amounts
    size, found = np.abs(want), [np.zeros(0, np.int64)]
    for length in np.flatnonzero(cells.length_n[row].any(axis=0)):
        rest = np.where(inside, size - size // TENS[length] * TENS[length], -1)
        starts = cells.length_at[row, length]
        ends, _ = _table(cells.by_length, starts, cells.length_n[row, length], -2)
        step = max(1, CELLS // (width * ends.shape[1]))
        for k in range(0, len(row), step):
            at, nth = np.divmod(np.flatnonzero(rest[k : k + step, :, None] == ends[k : k + step, None, :]), ends.shape[1])
            at += k * width
            longer = size.ravel()[at] >= TENS[length]
            keep = longer | (want.ravel()[at] >= 0)
            found.append((2 * at + longer << 32 | cells.rank[starts[at // width] + nth])[keep])
    best = np.sort(np.concatenate(found))  # of an amount the balance itself is best, then the first that ends it
    best = best[np.append(True, best[1:] >> 33 != best[:-1] >> 33)[: len(best)]]
    at, ends, rank = best >> 33, best >> 32 & 1, best & 2**32 - 1
    pair, nth = np.divmod(at, width)

    balances, there = _table(cells.balances, cells.b_at[row], np.minimum(cells.b_n[row], 40), 0)
    change = balances - previous[:, None]
    p, k = np.nonzero(there & (change != 0))
    shown = cells.shown(row[p], change[p, k])
    p, k = p[shown], k[shown]
    new = ~((amounts[p] == change[p, k][:, None]) & inside[p]).any(axis=1)
    p, k = p[new], k[new]
    return np.append(pair, p), np.append(10 * nth + rank + SUFFIX * ends, IMPLIED + 10 * k), np.append(nth, 40 + k), np.append(amounts[pair, nth], change[p, k]), np.append(want.ravel()[at], balances[p, k])


def _paired(cells, row, previous, n_amounts, n_balances, most):
    """The cheapest of the first amounts with the first balances; after a known balance they are breaks."""
    amounts, a_in = _table(cells.amounts, cells.a_at[row], np.minimum(cells.a_n[row], n_amounts), 0)
    balances, b_in = _table(cells.balances, cells.b_at[row], np.minimum(cells.b_n[row], n_balances), 0)
    width = balances.shape[1]
    cost = np.broadcast_to(10 * np.arange(amounts.shape[1])[:, None] + np.arange(width), (len(row), amounts.shape[1], width))
    if previous is not None:
        cost = cost + BROKEN + 100 * np.minimum(np.abs((previous[:, None] + amounts)[:, :, None] - balances[:, None, :]), BROKEN // 100)
    cost = np.where(a_in[:, :, None] & b_in[:, None, :], cost, LARGEST).reshape(len(row), -1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :most]
    pair, turn = np.nonzero(np.take_along_axis(cost, order, 1) < LARGEST)
    at = order[pair, turn]
    return pair, cost[pair, at], turn, amounts[pair, at // width], balances[pair, at % width]


def _options(cells, row, previous, follows):
    """Sorted options of all pairs; and where those of a pair begin, and how many there are."""
    parts = []

    def add(pairs, got):
        parts.append((pairs[got[0]], *got[1:]))
        return pairs[np.bincount(got[0], minlength=len(pairs)) == 0]

    readable = (cells.a_n[row] > 0) & (cells.b_n[row] > 0)
    if len(k := np.flatnonzero(follows)) and len(k := add(k, _linked(cells, row[k], previous[k]))):
        add(k, _paired(cells, row[k], previous[k], 12, 20, 10))
    if len(k := np.flatnonzero(readable & ~follows)):
        add(k, _paired(cells, row[k], None, 4, 8, 20))
    if len(k := np.flatnonzero(~readable)):
        first = lambda values, at, n: np.where(n > 0, values[np.where(n > 0, at, 0)], 0)
        same = np.arange(len(k))
        add(k, (same, np.full(len(k), UNREADABLE), 0 * same, first(cells.amounts, cells.a_at[row[k]], cells.a_n[row[k]]), first(cells.balances, cells.b_at[row[k]], cells.b_n[row[k]])))
    pair, cost, turn, amount, balance = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(pair << 40 | cost << 8 | turn)
    n = np.bincount(pair, minlength=len(row))
    return cost[order], amount[order], balance[order], np.cumsum(n) - n, np.minimum(n, 25)


class Beams:
    """The cheapest paths of statements, cheapest first; equal costs keep the order of their paths, then of their readings."""

    def __init__(self, statements: int, width: int):
        self.width = width
        self.cost, self.balance = np.zeros((2, statements, width), np.int64)
        self.paths, self.known = np.ones(statements, np.int64), np.zeros(statements, bool)

    def step(self, cells: Cells, rows):
        """Reads one more row of the first statements: the new paths' (parent, amount, balance)."""
        n, k = len(rows), np.arange(self.width)
        # paths with the same balance have the same options
        follows = self.known[:n] & (cells.a_n[rows] > 0) & (cells.b_n[rows] > 0)
        live = k < self.paths[:n, None]
        balance = np.where(live, self.balance[:n], self.balance[:n, :1]) * follows[:, None]
        order = np.argsort(balance, axis=1)
        ranked = np.take_along_axis(balance, order, 1)
        new = np.ones(ranked.shape, bool)
        new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        pair = np.empty((n, self.width), np.int64)
        np.put_along_axis(pair, order, np.cumsum(new).reshape(n, -1) - 1, 1)
        whose = np.nonzero(new)[0]
        c, a, b, starts, counts = _options(cells, rows[whose], ranked[new], follows[whose])

        s, path = np.nonzero(live)
        option, which = _spread(starts[pair[s, path]], counts[pair[s, path]])
        owner, cost = s[which], self.cost[s, path][which] + c[option]
        grown = np.bincount(owner, minlength=n)
        start = np.cumsum(grown) - grown
        more, nth = cost - self.cost[owner, 0], np.arange(len(owner)) - start[owner]
        bits, high = int(nth.max()).bit_length(), int(more.max()).bit_length()
        if n.bit_length() + high + bits < 63:
            nth = np.sort((owner << high | more) << bits | nth) & (1 << bits) - 1
        else:
            nth = nth[np.lexsort((more, owner))]
        self.paths[:n] = np.minimum(grown, self.width)
        nth, inside = _table(nth, start, self.paths[:n], 0, self.width)
        at = start[:, None] + nth
        taken = option[at]
        self.cost[:n], self.balance[:n], self.known[:n] = np.where(inside, cost[at], 0), np.where(inside, b[taken], 0), cells.b_n[rows] > 0
        if np.abs(self.balance[:n]).max() > LARGEST:
            raise OverflowError("balances beyond 64 bits of cents")
        return path[which[at]].astype(np.int16), a[taken], self.balance[:n].copy()


def _told(rows, start, has, amount, balance, sure):
    """Output of settled rows: start has the first row of each one's statement here, sure the balance before row 0."""
    k = np.arange(len(start))
    last = np.maximum.accumulate(np.where(has[1], k, -1))
    at = np.append(-1, last[:-1])
    inside = at >= start
    known = inside | (sure is not None and start == 0)
    before = np.where(inside, balance[at], sure or 0)
    code = np.where(~has[0], 1, np.where(~has[1], 2, np.where(known & (before + amount != balance), 3, 0)))
    issue = np.array([None, "amount_unreadable", "balance_unreadable", "balance_break"], object)[code]
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(amount, mask=~has[0]), pa.array(balance, mask=~has[1]), pa.array(issue, pa.string())], [*rows.schema.names, "amount", "balance", "issue"])


class Open:
    """A statement that may go on, and its rows that aren't settled: of each what its paths came from and read."""

    def __init__(self, key):
        self.key, self.sure, self.rows = key, None, None

    def add(self, beams, place, rows, has, steps):
        self.beam = (beams.cost[place], beams.balance[place], beams.paths[place], beams.known[place])
        steps = [np.stack([x[i][place] for x in steps]) for i in range(3)]
        if self.rows is not None:
            rows = pa.Table.from_batches([self.rows, rows]).combine_chunks().to_batches()[0]
            has, steps = np.append(self.has, has, axis=1), [np.append(x, y, axis=0) for x, y in zip(self.steps, steps)]
        self.rows, self.has, self.steps = rows, has, steps

    def settled(self, ends: bool):
        """Output of the rows that all paths agree on; of all rows if the statement ends."""
        parent, amount, balance = self.steps
        n, paths = len(parent), np.arange(1 if ends else self.beam[2])
        while n and len(paths) > 1:
            n -= 1
            paths = np.unique(parent[n, paths])
        if not n:
            return []
        took, k = np.zeros(n, np.int64), paths[0]
        for i in range(n - 1, -1, -1):
            took[i], k = k, parent[i, k]
        at, has = np.arange(n), self.has[:, :n]
        out = _told(self.rows.slice(0, n), np.zeros(n, np.int64), has, amount[at, took], balance[at, took], self.sure)
        if has[1].any():
            self.sure = int(balance[at, took][has[1]][-1])
        self.rows, self.has, self.steps = (self.rows.slice(n), self.has[:, n:], [x[n:] for x in self.steps]) if n < len(parent) else (None, None, None)
        return [out]


def _gathered(batches):
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + len(b)
        if n >= AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)


def read(batches, keys: list[str], width: int):
    """From sorted batches of keys, ingest_seq, amounts, balances and raw to keys, ingest_seq, amount, balance and issue."""
    last = None
    for batch in _gathered(batches):
        key = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        starts = np.array([i for i in range(len(key)) if not i or key[i] != key[i - 1]])
        goes_on = last is not None and last.key == key[0]
        if last is not None and not goes_on:
            yield from last.settled(True) if last.rows is not None else []
        lengths = np.diff(np.append(starts, len(key)))
        order = np.argsort(-lengths, kind="stable")  # so that the statements of each step come first
        place = np.argsort(order)
        cells, beams, steps = Cells(batch), Beams(len(starts), width), []
        if goes_on:
            beams.cost[place[0]], beams.balance[place[0]], beams.paths[place[0]], beams.known[place[0]] = last.beam
        for j in range(lengths.max()):
            steps.append(beams.step(cells, starts[order][: np.count_nonzero(lengths > j)] + j))

        rows, has = batch.select([*keys, "ingest_seq"]), np.stack([cells.a_n > 0, cells.b_n > 0])
        amount, balance, k = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(starts), np.int64)
        for j in range(len(steps) - 1, -1, -1):
            n = len(steps[j][0])
            at, here = starts[order][:n] + j, (np.arange(n), k[:n])
            amount[at], balance[at], k[:n] = steps[j][1][here], steps[j][2][here], steps[j][0][here]
        for i in sorted({0, len(starts) - 1}) if goes_on else [len(starts) - 1]:  # these go beyond the batch
            at, n = starts[i], lengths[i]
            if i == len(starts) - 1:
                a, z = (lengths[0] if goes_on else 0), at
                if a < z:
                    yield _told(rows.slice(a, z - a), np.repeat(starts, lengths)[a:z] - a, has[:, a:z], amount[a:z], balance[a:z], None)
            if i or not goes_on:
                last = Open(key[at])
            last.add(beams, place[i], rows.slice(at, n), has[:, at : at + n], steps[:n])
            yield from last.settled(i < len(starts) - 1)
    if last is not None and last.rows is not None:
        yield from last.settled(True)
