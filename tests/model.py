"""A sequential model of the merge rules, row by row, as an oracle for the set-wise operators."""


def clock_key(h):
    time, _, node = h.partition("/")

    def number(s, base, bound):
        s = s.removeprefix("+")
        try:
            n = int(s, base) if s and s.isascii() and s.isalnum() else 0
        except ValueError:
            n = 0
        return n if n < bound else 0

    return number(time, 10, 1 << 64), number(node, 16, 1 << 128)


class Model:
    """One table `t` (key k) and its delete log. rows: key → (row clock, {column: clock}, {column: value})."""

    def __init__(self):
        self.rows, self.log = {}, {}

    def apply(self, batch):
        """batch: (kind, key, column, clock, value); kind `set`, or `delete` (a log entry `column` names key). Returns status by index."""
        status, shadows = {}, {}
        for key, clock in self.log.values():
            shadows[key] = max(shadows.get(key, (0, 0)), clock_key(clock))
        inbound = []
        by_row = {}
        for i, change in enumerate(batch):
            by_row.setdefault((change[0], change[1] if change[0] == "set" else change[2]), []).append((i, change))
        for (kind, row), changes in by_row.items():
            if kind == "delete":
                for i, (_, key, entry, clock, _) in sorted(changes, key=lambda c: (clock_key(c[1][3]), c[0])):
                    inbound.append(entry)
                    if "/" in clock and (entry not in self.log or clock_key(clock) > clock_key(self.log[entry][1])):
                        self.log[entry] = (key, clock)
                        status[i] = "applied"
                    else:
                        status[i] = "stale"
                continue
            stored = self.rows.get(row)
            best, first = {}, {}
            for i, (_, _, column, clock, value) in sorted(changes, key=lambda c: (clock_key(c[1][3]), c[0])):
                known = clock_key(stored[1].get(column, "")) if stored else (0, 0)
                if "/" in clock and clock_key(clock) > known:
                    first.setdefault(column, (clock_key(clock), i))
                    if column not in best or clock_key(clock) > clock_key(best[column][1]):
                        best[column] = (i, clock, value)
            for i, (_, _, column, clock, _) in changes:
                won = column in best and best[column][0] == i
                status[i] = "applied" if won else "superseded_in_batch" if column in first and (clock_key(clock), i) >= first[column] else "stale"
            if not best:
                continue
            newest = max((b[1] for b in best.values()), key=clock_key)
            if stored is None:
                if row in shadows and shadows[row] >= clock_key(newest):
                    for i, _, _ in best.values():
                        status[i] = "shadowed_by_delete"
                    continue
                stored = ("", {}, {})
            row_clock = stored[0] if stored[0] and clock_key(stored[0]) >= clock_key(newest) else newest
            self.rows[row] = (row_clock, stored[1] | {c: b[1] for c, b in best.items()}, stored[2] | {c: b[2] for c, b in best.items()})
        for entry in dict.fromkeys(inbound):
            if entry in self.log:
                key, clock = self.log[entry]
                if key in self.rows and clock_key(self.rows[key][0]) <= clock_key(clock):
                    del self.rows[key]
        return status
