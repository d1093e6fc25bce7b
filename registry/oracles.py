"""SQL that DuckDB answers from the same tables, written from the definitions.

Nothing here follows the shape of the Spark plans: hits are ranks over the whole
table, surfaces damage every order once per combination, attribution is the
textbook sum.
"""

from __future__ import annotations

from registry import settings as cfg
from registry.queries import _texts
from tarnish.functions import dice
from tarnish.functions.dice import seed_words
from tarnish.sources import generator as gen
from tarnish.sources.star import LINE_KEY

BIT = {name: 1 << i for i, name in enumerate(cfg.CHANNELS)}


# ---- building blocks ---------------------------------------------------------


def roll(key: str, seeds) -> str:
    m1, m2, m3, m4 = dice.MULTIPLIERS
    mask = dice.MASK
    a = f"(xor(({key})::BIGINT & {mask}, {seeds[0]}::BIGINT) * {m1} + (({key})::BIGINT >> 31) * {m2})"
    c = f"(xor(xor({a}, {a} >> 29) & {mask}, {seeds[1]}::BIGINT) * {m3})"
    return f"((((xor({c}, {c} >> 31) & {mask}) * {m4}) >> 22) & {mask})"


def unit(rolled: str) -> str:
    return f"(({rolled})::DOUBLE + 0.5::DOUBLE) / 2147483648::DOUBLE"


def normal(first: str, second: str) -> str:
    return f"(sqrt(-2::DOUBLE * ln({unit(first)})) * cos(2::DOUBLE * pi() * {unit(second)}))"


def share53(high: str, low: str) -> str:
    return f"((({high}) * 4194304 + (({low}) >> 9))::DOUBLE / 9007199254740992::DOUBLE)"


def pick(high: str, low: str, size: str) -> str:
    return f"least(floor({share53(high, low)} * ({size}))::BIGINT, ({size})::BIGINT - 1)"


def hit_count(severity, size: str) -> str:
    return f"least({size}, greatest(1, round_even({severity}::DOUBLE * {size}, 0)))::BIGINT"


def r(text: str, digits: int = 6) -> str:
    return f"(round(({text})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def values(rows) -> str:
    def one(v) -> str:
        if isinstance(v, str):
            return "'" + v + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + ")"


class Ctes:
    """A growing WITH list."""

    def __init__(self, *parts: tuple[str, str]):
        self.parts = list(parts)

    def add(self, name: str, body: str) -> Ctes:
        return Ctes(*self.parts, (name, body))

    def add_all(self, parts) -> Ctes:
        return Ctes(*self.parts, *parts)

    def select(self, body: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in self.parts) + "\n" + body


STAR = Ctes(
    (
        "cust",
        "SELECT c_custkey::BIGINT AS customer_id, r_name AS region, c_mktsegment AS segment FROM customer"
        " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    ("prod", "SELECT p_partkey::BIGINT AS product_id, p_type AS category, p_retailprice::DOUBLE AS base_price FROM part"),
    (
        "fact",
        f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS order_id, o_custkey::BIGINT AS customer_id,"
        " l_partkey::BIGINT AS product_id, l_shipdate AS order_date, l_quantity::DOUBLE AS quantity,"
        " l_extendedprice / l_quantity AS unit_price, l_discount::DOUBLE AS discount,"
        " CASE l_returnflag WHEN 'N' THEN 'completed' WHEN 'R' THEN 'refunded' ELSE 'cancelled' END AS status"
        " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
)
EVENTS = Ctes(
    (
        "cust",
        "SELECT DISTINCT user_id AS customer_id, 'zone_' || (user_id % 5) AS region, 'tier_' || (user_id % 3) AS segment"
        " FROM events",
    ),
    (
        "prod",
        "SELECT row_number() OVER (ORDER BY event_type) - 1 AS product_id, event_type AS category, 1::DOUBLE AS base_price"
        " FROM (SELECT DISTINCT event_type FROM events)",
    ),
    (
        "fact",
        "SELECT event_id AS order_id, user_id AS customer_id, product_id, ts AS order_date, 1::DOUBLE AS quantity,"
        " value AS unit_price, 0::DOUBLE AS discount, CASE event_type WHEN 'error' THEN 'cancelled'"
        " WHEN 'signup' THEN 'refunded' ELSE 'completed' END AS status"
        " FROM events JOIN prod ON event_type = category",
    ),
)


def levels(name: str, sets: list[tuple[int, float, tuple]], table: str) -> list[tuple[str, str]]:
    """CTE ``name`` (sid, times, m): how many rows are drawn at least ``times`` times.

    ``sets`` are (sid, severity, label) and ``table`` is a CTE or table to draw from.
    """
    rows = []
    for sid, severity, label in sets:
        words = [w for part in ("block-high", "block-low", "place-high", "place-low") for w in seed_words(*label, part)]
        rows.append((sid, float(severity), *words))
    columns = "sid, severity, a0, a1, b0, b1, c0, c1, d0, d1"
    blocks = f"{name}_blocks"
    start, stop = "((block * n + b - 1) // b)", "(((block + 1) * n + b - 1) // b)"
    return [
        (f"{name}_size", f"SELECT count(*)::BIGINT AS n, least(count(*), 4096)::BIGINT AS b FROM {table}"),
        (f"{name}_sets", f"SELECT * FROM {values(rows)} AS t({columns})"),
        (
            f"{name}_draws",
            f"SELECT s.*, n, b, unnest(range({hit_count('severity', 'n')})) AS j FROM {name}_sets s, {name}_size",
        ),
        (
            blocks,
            "SELECT sid, c0, c1, d0, d1, n, b, block, count(*) AS c FROM (SELECT *, ("
            + pick(roll("j", ("a0", "a1")), roll("j", ("b0", "b1")), "n")
            + f" * b) // n AS block FROM {name}_draws) GROUP BY ALL",
        ),
        (
            f"{name}_places",
            "SELECT sid, block, "
            + pick(roll("key", ("c0", "c1")), roll("key", ("d0", "d1")), "width")
            + f" AS place FROM (SELECT *, block * 1099511627776 + i AS key, {stop} - {start} AS width"
            f" FROM (SELECT *, unnest(range(c)) AS i FROM {blocks}))",
        ),
        (
            f"{name}_times",
            f"SELECT sid, times, count(*) AS c FROM (SELECT sid, block, place, count(*) AS times FROM {name}_places"
            " GROUP BY ALL) GROUP BY ALL",
        ),
        (
            name,
            f"SELECT t.sid, k AS times, sum(t.c)::BIGINT AS m FROM {name}_times t,"
            f" range(1, 1 + (SELECT max(times) FROM {name}_times)) AS g(k) WHERE t.times >= k GROUP BY ALL",
        ),
    ]


def copies(name: str, sets: list[tuple[int, float, tuple]], table: str, key: str) -> list[tuple[str, str]]:
    """CTE ``name`` (sid, key, k): rows with the number of extra copies they get."""
    seeds = values([(sid, *seed_words(*label, "rows")) for sid, _, label in sets])
    return levels(f"{name}_levels", sets, table) + [
        (
            f"{name}_ranks",
            f"SELECT sid, {key}, row_number() OVER (PARTITION BY sid ORDER BY {roll(key, ('e0', 'e1'))}, {key}) AS place"
            f" FROM {table}, {seeds} AS t(sid, e0, e1)",
        ),
        (
            name,
            f"SELECT q.sid, {key}, count(*)::BIGINT AS k FROM {name}_ranks q JOIN {name}_levels l"
            " ON q.sid = l.sid AND place <= m GROUP BY ALL",
        ),
    ]


def defect_seeds(repeat: int, name: str, *stream: str) -> tuple[int, int]:
    return seed_words("defect", cfg.MASTER, repeat, name, *stream)


def hits(scenarios: list[tuple[int, float, int]]) -> list[tuple[str, str]]:
    """CTEs ``oh`` and ``ch``: per scenario (sid, severity, repeat), orders and customers with their hit flags."""
    streams = [(n,) for n in cfg.CHANNELS[:5]] + [("value_noise", "radius"), ("value_noise", "angle")]
    rows = []
    for sid, severity, repeat in scenarios:
        words = [w for s in streams for w in defect_seeds(repeat, *s)]
        rows.append((sid, float(severity), repeat, *words))
    names = ["mm", "vn", "fk", "ts", "dd", "vr", "va"]
    columns = ", ".join(f"{n}{i}" for n in names for i in (0, 1))

    def flag(n: str, key: str, size: str) -> str:
        place = f"row_number() OVER (PARTITION BY sid ORDER BY {roll(key, (n + '0', n + '1'))}, {key})"
        return f"{place} <= {hit_count('severity', size)} AS hit_{n}"

    flags = ", ".join(flag(n, "order_id", "n_fact") for n in ("mm", "vn", "fk", "ts"))
    factor = f"exp({normal(roll('order_id', ('vr0', 'vr1')), roll('order_id', ('va0', 'va1')))})"
    draws = [(sid, severity, ("copies", cfg.MASTER, repeat, "duplicate_facts")) for sid, severity, repeat in scenarios]
    return [
        ("scen", f"SELECT * FROM {values(rows)} AS t(sid, severity, repeat, {columns})"),
        ("sizes", "SELECT (SELECT count(*) FROM fact) AS n_fact, (SELECT count(*) FROM cust) AS n_cust"),
        *copies("dup", draws, "fact", "order_id"),
        (
            "oh",
            f"SELECT s.sid, s.severity, s.repeat, f.*, {flags}, {factor} AS factor FROM fact f, scen s, sizes",
        ),
        (
            "cycle",
            "SELECT region AS old_region, coalesce(lead(region) OVER (ORDER BY region),"
            " first(region) OVER (ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
            " AS next_region FROM (SELECT DISTINCT region FROM cust)",
        ),
        (
            "ch",
            f"SELECT s.sid, c.*, next_region, {flag('dd', 'customer_id', 'n_cust')}"
            " FROM cust c JOIN cycle ON c.region = old_region, scen s, sizes",
        ),
    ]


def damaged(masks: str, bits: dict[str, int]) -> list[tuple[str, str]]:
    """CTE ``hurt``: every order of every scenario under every mask, with weight ``w`` for copies."""

    def on(name: str, flag: str) -> str:
        return f"(mask & {bits.get(name, 0)} <> 0 AND {flag})"

    price = (
        f"CASE WHEN {on('missing_measures', 'hit_mm')} THEN NULL"
        f" WHEN {on('value_noise', 'hit_vn')} THEN unit_price * factor ELSE unit_price END"
    )
    return [
        ("masks", masks),
        (
            "hurt",
            f"SELECT o.sid, severity, repeat, mask, o.order_id, o.customer_id, o.product_id, quantity, discount, status,"
            f" {price} AS unit_price, {on('orphan_foreign_keys', 'hit_fk')} AS orphan,"
            f" CASE WHEN {on('stale_timestamps', 'hit_ts')} THEN order_date - INTERVAL 365 DAY ELSE order_date END AS order_date,"
            f" CASE WHEN {on('dimension_drift', 'hit_dd')} THEN next_region ELSE region END AS region, segment, category,"
            f" CASE WHEN mask & {bits.get('duplicate_facts', 0)} <> 0 THEN 1 + coalesce(k, 0) ELSE 1 END AS w"
            " FROM oh o JOIN ch USING (sid, customer_id) JOIN prod USING (product_id)"
            " LEFT JOIN dup ON o.sid = dup.sid AND o.order_id = dup.order_id, masks",
        ),
    ]


NET = "quantity * unit_price * (1 - discount)"


def losses() -> list[tuple[str, str]]:
    """CTE ``losses`` (severity, repeat, query, mask, loss)."""
    net = f"sum(w * {NET})"
    done = "status = 'completed'"

    def answer(name: str, key: str, value: str, where: str) -> str:
        return (
            f"SELECT sid, severity, repeat, mask, '{name}' AS query, ({key})::VARCHAR AS key, ({value})::DOUBLE AS v"
            f" FROM hurt WHERE {where} GROUP BY ALL"
        )

    parts = [
        answer("revenue_region", "region", net, f"{done} AND NOT orphan"),
        answer("revenue_month", "date_trunc('month', order_date)::DATE", net, done),
        answer("revenue_category", "category", net, done),
        answer("aov_segment", "segment", f"{net} / sum(CASE WHEN unit_price IS NOT NULL THEN w END)", f"{done} AND NOT orphan"),
        answer("refund_region", "region", "sum(CASE WHEN status = 'refunded' THEN w ELSE 0 END)::DOUBLE / sum(w)", "NOT orphan"),
        answer("orders_status", "status", "sum(w)", "true"),
        answer("customers_region", "region", "count(DISTINCT customer_id)", "NOT orphan"),
        answer("daily_revenue", "order_date::DATE", net, done),
    ]
    return [
        ("answers", " UNION ALL ".join(parts)),
        (
            "aligned",
            "SELECT severity, repeat, query, mask, key, sum(ref) AS ref, sum(obs) AS obs FROM ("
            "SELECT severity, repeat, query, m.mask, key, coalesce(v, 0) AS ref, 0 AS obs FROM answers a, masks m WHERE a.mask = 0"
            " UNION ALL SELECT severity, repeat, query, mask, key, 0, coalesce(v, 0) FROM answers) GROUP BY ALL",
        ),
        (
            "losses",
            "SELECT severity, repeat, query, mask::BIGINT AS mask,"
            " least(1, sum(abs(obs - ref)) / (sum(abs(ref)) + 1e-12)) AS loss FROM aligned GROUP BY ALL",
        ),
        ("risks", "SELECT severity, repeat, mask, avg(loss) AS loss FROM losses GROUP BY ALL"),
        ("game", "SELECT severity, mask, avg(loss) AS value FROM risks GROUP BY ALL"),
    ]


def every_mask(m: int) -> str:
    return f"SELECT unnest(range({1 << m})) AS mask"


def surface(base: Ctes, severities, repeats, channels=cfg.CHANNELS) -> Ctes:
    scenarios, sid = [], 0
    for severity in severities:
        for repeat in repeats:
            scenarios.append((sid, severity, repeat))
            sid += 1
    bits = {name: 1 << i for i, name in enumerate(channels)}
    return base.add_all(hits(scenarios)).add_all(damaged(every_mask(len(channels)), bits)).add_all(losses())


LINES = surface(STAR, [cfg.SEVERITY], range(cfg.REPEATS))
ONE = surface(STAR, [cfg.SEVERITY], [0])


def players(channels=cfg.CHANNELS) -> tuple[str, str]:
    rows = [(i, 1 << i, name) for i, name in enumerate(channels)]
    return "players", f"SELECT * FROM {values(rows)} AS t(idx, bit, player)"


def marginals(game: str, groups: str = "") -> tuple[str, str]:
    """CTE ``marg``: v(S + i) - v(S) for every player and coalition without it."""
    g = f"{groups}, " if groups else ""
    using = f"AND {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in groups.split(','))}" if groups else ""
    ga = "".join(f"a.{c.strip()}, " for c in groups.split(",")) if groups else ""
    del g
    return (
        "marg",
        f"SELECT {ga}idx, player, a.mask, bit_count(a.mask)::BIGINT AS size, b.value - a.value AS marginal"
        f" FROM {game} a, players p, {game} b WHERE a.mask & bit = 0 AND b.mask = a.mask | bit {using}",
    )


def shapley(m: int, groups: str = "") -> tuple[str, str]:
    g = f"{groups}, " if groups else ""
    return (
        "phi",
        f"SELECT {g}idx, player, sum(factorial(size::INTEGER)::DOUBLE * factorial(({m} - size - 1)::INTEGER)::DOUBLE"
        f" / factorial({m})::DOUBLE * marginal) AS debt, sum(marginal) / {1 << (m - 1)}::DOUBLE AS banzhaf,"
        f" max(CASE WHEN size = 0 THEN marginal END) AS singleton,"
        f" max(CASE WHEN size = {m - 1} THEN marginal END) AS current_gain FROM marg GROUP BY ALL",
    )


def game_of(source: str, groups: str = "") -> tuple[str, str]:
    g = f"{groups}, " if groups else ""
    return "g", f"SELECT {g}mask, avg(loss) AS value FROM {source} GROUP BY ALL"


def accounts(base: Ctes, source: str, groups: str = "", channels=cfg.CHANNELS) -> Ctes:
    """Adds players, g (mean game), marg and phi for a table (groups, repeat, mask, loss)."""
    m = len(channels)
    return base.add_all([players(channels), game_of(source, groups), marginals("g", groups), shapley(m, groups)])


def boot(base: Ctes, source: str, repeats: list[int], groups: str = "", channels=cfg.CHANNELS) -> Ctes:
    """Adds ``slots`` (draw, slot, repeat) and ``bphi`` (groups, draw, idx, player, debt, gain)."""
    size, m = len(repeats), len(channels)
    rolled = roll("i", seed_words("bootstrap", cfg.SEED, "paired"))
    listed = "[" + ", ".join(str(x) for x in repeats) + "]"
    g = f"{groups}, " if groups else ""
    gs = "".join(f"x.{c.strip()}, " for c in groups.split(",")) if groups else ""
    eq = "".join(f" AND a.{c.strip()} = b.{c.strip()}" for c in groups.split(",")) if groups else ""
    ga = "".join(f"a.{c.strip()}, " for c in groups.split(",")) if groups else ""
    weight = (
        f"factorial(bit_count(a.mask)::INTEGER)::DOUBLE * factorial(({m} - bit_count(a.mask) - 1)::INTEGER)::DOUBLE"
        f" / factorial({m})::DOUBLE"
    )
    return base.add_all(
        [
            (
                "slots",
                f"SELECT (i // {size})::INTEGER AS draw, (i % {size})::INTEGER AS slot,"
                f" ({listed})[(({rolled} * {size}) >> 31) + 1]::INTEGER AS repeat FROM range({cfg.DRAWS * size}) AS t(i)",
            ),
            (
                "bmean",
                f"SELECT {gs}draw, mask, avg(loss) AS value FROM {source} x JOIN slots USING (repeat) GROUP BY ALL",
            ),
            (
                "bphi",
                f"SELECT {ga}a.draw, idx, player, sum({weight} * (b.value - a.value)) AS debt,"
                f" max(CASE WHEN bit_count(a.mask) = {m - 1} THEN b.value - a.value END) AS gain"
                f" FROM bmean a, players, bmean b WHERE a.mask & bit = 0 AND b.mask = a.mask | bit AND a.draw = b.draw{eq}"
                " GROUP BY ALL",
            ),
            (
                "branked",
                f"SELECT *, row_number() OVER (PARTITION BY {g}draw ORDER BY round(debt, 12) DESC, idx) AS place FROM bphi",
            ),
            (
                "intervals",
                f"SELECT {g}idx, player, quantile_cont(debt, 0.025) AS ci_low, quantile_cont(debt, 0.975) AS ci_high,"
                " avg((round(debt, 12) > 0)::INTEGER) AS probability_harmful, avg((place = 1)::INTEGER) AS rank_1_probability,"
                " quantile_cont(gain, 0.025) AS gain_ci_low, quantile_cont(gain, 0.975) AS gain_ci_high"
                " FROM branked GROUP BY ALL",
            ),
        ]
    )


ESTIMATES = (
    "debt",
    "ci_low",
    "ci_high",
    "probability_harmful",
    "rank_1_probability",
    "singleton",
    "current_gain",
    "gain_ci_low",
    "gain_ci_high",
    "banzhaf",
)


def estimates(base: Ctes, groups: str = "", leave: tuple[str, ...] = ()) -> str:
    g = f"{groups}, " if groups else ""
    columns = ", ".join(f"{r(c)} AS {c}" for c in ESTIMATES if c not in leave)
    using = ", ".join([*(c.strip() for c in groups.split(",") if c.strip()), "idx", "player"])
    return base.select(f"SELECT {g}player AS channel, {columns} FROM phi JOIN intervals USING ({using})")


def interactions(groups: str = "", m: int = 6) -> tuple[str, str]:
    g = f"{groups}, " if groups else ""
    eq = [c.strip() for c in groups.split(",") if c.strip()]

    def same(x: str) -> str:
        return "".join(f" AND s.{c} = {x}.{c}" for c in eq)

    sg = "".join(f"s.{c}, " for c in eq)
    del g
    return (
        "pairs",
        f'SELECT {sg}a.player AS "left", b.player AS "right", sum(factorial(bit_count(s.mask)::INTEGER)::DOUBLE'
        f" * factorial(({m} - bit_count(s.mask) - 2)::INTEGER)::DOUBLE / factorial({m - 1})::DOUBLE"
        " * (sab.value - sa.value - sb.value + s.value)) AS interaction"
        " FROM g s, players a, players b, g sa, g sb, g sab WHERE a.idx < b.idx AND s.mask & (a.bit | b.bit) = 0"
        " AND sa.mask = s.mask | a.bit AND sb.mask = s.mask | b.bit AND sab.mask = s.mask | a.bit | b.bit"
        f"{same('sa')}{same('sb')}{same('sab')} GROUP BY ALL",
    )


def decisions(groups: str = "") -> tuple[str, str]:
    g = f"{groups}, " if groups else ""

    def best(column: str, score: str) -> str:
        return f"arg_max({column}, {{'s': {score}, 'i': -idx}})"

    return (
        "decided",
        f"SELECT {g}{best('player', 'debt')} AS shapley_choice, {best('player', 'singleton')} AS singleton_choice,"
        f" {best('player', 'current_gain')} AS oracle_choice, {best('current_gain', 'debt')} AS shapley_gain,"
        f" {best('current_gain', 'singleton')} AS singleton_gain, {best('current_gain', 'current_gain')} AS oracle_gain,"
        " avg(current_gain) AS uniform_gain FROM phi GROUP BY ALL",
    )


def accounting(groups: str = "", m: int = 6) -> tuple[str, str]:
    g = f"{groups}, " if groups else ""
    full = (1 << m) - 1
    join = f"USING ({groups})" if groups else "ON true"
    return (
        "totals",
        f"SELECT *, full_risk - clean_risk AS total_debt, d - (full_risk - clean_risk) AS efficiency_residual,"
        f" z - (full_risk - clean_risk) AS banzhaf_residual FROM (SELECT {g}max(CASE WHEN mask = {full} THEN value END)"
        f" AS full_risk, max(CASE WHEN mask = 0 THEN value END) AS clean_risk FROM g GROUP BY ALL)"
        f" JOIN (SELECT {g}sum(debt) AS d, sum(banzhaf) AS z FROM phi GROUP BY ALL) {join}",
    )


TOTALS = ("full_risk", "clean_risk", "total_debt", "efficiency_residual", "banzhaf_residual")
GAINS = ("shapley_gain", "singleton_gain", "oracle_gain", "uniform_gain")


def summary(base: Ctes, repeats: int, groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    base = base.add_all(
        [
            interactions(groups),
            decisions(groups),
            accounting(groups),
            (
                "strongest",
                f"SELECT {g}max(abs(interaction)) AS max_abs_interaction FROM pairs GROUP BY ALL",
            ),
            (
                "tops",
                f"SELECT {g}arg_max(player, {{'s': debt, 'i': -idx}}) AS top_channel,"
                f" arg_max(rank_1_probability, {{'s': debt, 'i': -idx}}) AS top_probability"
                f" FROM phi JOIN intervals USING ({g}idx, player) GROUP BY ALL",
            ),
        ]
    )
    join = f"USING ({groups})" if groups else "ON true"
    numbers = ", ".join(f"{r(c)} AS {c}" for c in (*TOTALS, "top_probability", "max_abs_interaction", *GAINS))
    # the mean of so many repeats, for all combinations at once
    radius = f"least(2, 2 * sqrt(ln({2 ** (len(cfg.CHANNELS) + 1)} / 0.05) / (2 * {repeats})))"
    return base.select(
        f"SELECT {g}{numbers}, {repeats}::BIGINT AS repeats, top_channel, shapley_choice, singleton_choice, oracle_choice,"
        f" 64::BIGINT AS coalitions, {r(radius)} AS hoeffding_radius"
        f" FROM totals JOIN decided {join} JOIN strongest {join} JOIN tops {join}"
    )


def order_radius(m: int, independent: int) -> str:
    """The half width that holds for all m players at 95 %, from so many independent orders."""
    return f"sqrt(2 * ln(2 * {m} / 0.05) / {independent})"


def orders_cte(
    count: str, antithetic: bool = False, draws: str | None = None, m: int = len(cfg.CHANNELS)
) -> list[tuple[str, str]]:
    """CTEs ``ord`` (draw, position, idx, bit, player) and ``walk`` (adds mask and before)."""
    base = "draw - draw % 2" if antithetic else "draw"
    key = roll(f"({base}) * {m} + idx", seed_words("orders", cfg.SEED))
    place = f"row_number() OVER (PARTITION BY draw ORDER BY {key}, idx) - 1"
    if antithetic:
        place = f"CASE WHEN draw % 2 = 1 THEN {m - 1} - ({place}) ELSE {place} END"
    source = draws or f"SELECT i AS draw FROM range({count}) AS t(i)"
    return [
        ("ord", f"SELECT *, ({place})::INTEGER AS position FROM ({source}), players"),
        (
            "walk",
            "SELECT *, mask - bit AS before FROM (SELECT *, sum(bit) OVER (PARTITION BY draw ORDER BY position"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS mask FROM ord)",
        ),
    ]


CONTRIB = (
    "contrib",
    "SELECT w.*, a.value - b.value AS contribution FROM walk w JOIN g a ON a.mask = w.mask JOIN g b ON b.mask = w.before",
)


def double_bits(x: str) -> str:
    """SQL value: a double's 53 binary digits as a whole number, and its power of two."""
    size = f"abs({x}::DOUBLE)"
    guess = f"floor(log2(greatest({size}, 4.9e-324::DOUBLE)))"

    def leading(power: str) -> str:
        half = f"floor(-({power}) / 2)"
        return f"({size} * pow(2::DOUBLE, {half}) * pow(2::DOUBLE, -({power}) - {half}))"

    power = f"({guess} + CASE WHEN {leading(guess)} >= 2 THEN 1 WHEN {leading(guess)} < 1 THEN -1 ELSE 0 END)"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' WHEN {x} = 0 THEN '0'"
        f" ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN isinf({x}) THEN 'Infinity'"
        f" ELSE TRY_CAST({leading(power)} * 4503599627370496 AS BIGINT)::VARCHAR || 'p' || TRY_CAST({power} AS BIGINT)::VARCHAR END END"
    )


# ---- the oracles -------------------------------------------------------------


def source_sql() -> dict[str, str]:
    rows = (
        "SELECT order_id, customer_id, product_id, strftime(order_date, '%Y-%m-%d') AS order_date, quantity,"
        f" {r('unit_price', 9)} AS unit_price, discount, status FROM fact"
    )
    prints = []
    number = double_bits
    written = {
        "text": "{}::VARCHAR".format,
        "number": number,
        "time": "epoch_us({})::VARCHAR".format,
        "vector": lambda c: f"array_to_string(list_transform({c}, lambda x: {number('x')}), ',')",
    }
    for name, kinds in cfg.FINGERPRINTS.items():
        cells = [(c, written[kind](c)) for kind, columns in kinds.items() for c in columns]
        text = " || ".join(f"coalesce(length({v})::VARCHAR || ':' || {v}, 'N')" for _, v in sorted(cells))
        prints.append(
            f"SELECT '{name}' AS table_name, count(*)::BIGINT AS rows,"
            " sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS total,"
            f" bit_xor(('0x' || substr(h, 9, 15))::BIGINT) AS mix FROM (SELECT sha256({text}) AS h FROM {name})"
        )
    names = sorted((n, 1 << i) for i, n in enumerate(cfg.CHANNELS))
    listed = "list_filter([" + ", ".join(f"CASE WHEN mask & {b} <> 0 THEN '{n}' END" for n, b in names) + "], lambda x: x IS NOT NULL)"
    key = f"CASE WHEN mask = 0 THEN 'EMPTY' ELSE array_to_string({listed}, '|') END"
    quoted = f"CASE WHEN mask = 0 THEN '[]' ELSE '[\"' || array_to_string({listed}, '\",\"') || '\"]' END"
    records = (
        f"SELECT repeat::INTEGER AS repeat, mask::BIGINT AS mask, {key} AS coalition_key, '{{\"coalition\":' || {quoted}"
        f" || ',\"coalition_key\":\"' || {key} || '\",\"coalition_size\":' || bit_count(mask)::VARCHAR || ',\"mask\":'"
        " || mask::VARCHAR || ',\"repeat\":' || repeat::VARCHAR || '}' AS record"
        f" FROM range({cfg.REPEATS}) AS a(repeat), range(64) AS b(mask) WHERE (SELECT count(*) FROM lineitem) > 0"
    )
    return {
        "star_fact": STAR.select(rows),
        "star_customers": STAR.select("SELECT * FROM cust"),
        "lookup_csv": STAR.select("SELECT customer_id, CASE WHEN region = 'ASIA' THEN 'Unknown' ELSE region END AS region, segment FROM cust"),
        "star_products": STAR.select("SELECT * FROM prod"),
        "star_events": EVENTS.select(
            "SELECT order_id, customer_id, region, segment, product_id, category,"
            " strftime(order_date, '%Y-%m-%d') AS order_date, quantity, unit_price, discount, status"
            " FROM fact JOIN cust USING (customer_id) JOIN prod USING (product_id)"
        ),
        "table_fingerprint": " UNION ALL ".join(prints),
        "range_scan": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem"
        f" WHERE l_shipdate >= '{cfg.SCAN_DATES[0]}' AND l_shipdate < '{cfg.SCAN_DATES[1]}'"
        f" AND l_quantity BETWEEN {cfg.SCAN_QUANTITY[0]} AND {cfg.SCAN_QUANTITY[1]}",
        "observation_records": records,
    }


def categorical(share: str, options) -> str:
    total, running, text = sum(w for _, w in options), 0.0, "CASE"
    for value, weight in options[:-1]:
        running += weight / total
        shown = f"'{value}'" if isinstance(value, str) else f"{value!r}::DOUBLE"
        text += f" WHEN s_ < {running!r}::DOUBLE THEN {shown}"
    last = options[-1][0]
    shown = f"'{last}'" if isinstance(last, str) else f"{last!r}::DOUBLE"
    return text.replace("s_", share) + f" ELSE {shown} END"


def generator_sql() -> dict[str, str]:
    """What the generator of test stars makes; its tables are no queries over given data, so only a test asks for them."""
    seed = cfg.GENERATOR_SEED

    def rolled(table: str, column: str, key: str = "id") -> str:
        return roll(key, gen.seeds(seed, table, column))

    def lognormal(table: str, column: str, mean: float, sigma: float, key: str = "id") -> str:
        z = normal(rolled(table, f"{column}-radius", key), rolled(table, f"{column}-angle", key))
        return f"exp({mean!r}::DOUBLE + {sigma!r}::DOUBLE * {z})"

    n = f"(SELECT greatest({gen.MIN_ORDERS}, count(*))::BIGINT FROM lineitem)"
    base = Ctes(
        ("size", f"SELECT {n} AS n, greatest(1000, {n} // 20) AS nc, greatest(250, {n} // 200) AS np"),
    )
    customers = base.select(
        f"SELECT id AS customer_id, {categorical(unit(rolled('customers', 'region')), gen.REGIONS)} AS region,"
        f" {categorical(unit(rolled('customers', 'segment')), gen.SEGMENTS)} AS segment"
        " FROM (SELECT unnest(range(nc)) AS id FROM size)"
    )
    even = [(c, 1.0) for c in gen.CATEGORIES]
    products = base.select(
        f"SELECT id AS product_id, {categorical(unit(rolled('products', 'category')), even)} AS category,"
        f" {r(lognormal('products', 'base_price', 3.0, 0.8))} AS base_price FROM (SELECT unnest(range(np)) AS id FROM size)"
    )

    def picked(column: str, size: str) -> str:
        return pick(rolled("orders", column), rolled("orders", column + "-low"), size)

    share = share53(rolled("orders", "customer"), rolled("orders", "customer-low"))
    # the running sum over all ranks, in closed form beyond the head
    s, h = gen.ZIPF, gen.ZIPF_HEAD
    head = values([(k - 1, float(k**-s)) for k in range(1, h + 1)])
    zipf = base.add_all(
        [
            ("head0", f"SELECT * FROM {head} AS t(rank, weight)"),
            (
                "mass",
                f"SELECT (SELECT sum(weight) FROM head0) AS inner_mass, (SELECT sum(weight) FROM head0)"
                f" + (pow({h + 0.5}::DOUBLE, {1 - s!r}::DOUBLE) - pow(nc + 0.5::DOUBLE, {1 - s!r}::DOUBLE)) / {s - 1!r}::DOUBLE"
                " AS all_mass FROM size",
            ),
            ("heads", "SELECT rank, coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / all_mass AS low FROM head0, mass"),
            ("drawn", f"SELECT id, nc, np, {share} AS share FROM (SELECT unnest(range(n)) AS id, nc, np FROM size)"),
            (
                "chosen",
                "SELECT id, nc, np, CASE WHEN share < inner_mass / all_mass THEN (SELECT max(rank) FROM heads WHERE low <= share)"
                f" ELSE least(greatest(floor(pow(pow({h + 0.5}::DOUBLE, {1 - s!r}::DOUBLE)"
                f" - (share * all_mass - inner_mass) * {s - 1!r}::DOUBLE, {1 / (1 - s)!r}::DOUBLE) + 0.5::DOUBLE)::BIGINT - 1,"
                f" {h}), nc - 1) END AS customer_id FROM drawn, mass",
            ),
        ]
    )
    season = values([(low, high, day) for low, high, day in gen.season_table()])
    even_customers = base.add(
        "chosen", f"SELECT id, nc, np, {picked('customer', 'nc')} AS customer_id FROM (SELECT unnest(range(n)) AS id, nc, np FROM size)"
    )
    plain_day = f"{picked('day', str(gen.DAYS))}"

    def orders(ctes: Ctes, day: str) -> str:
        ctes = ctes.add("goods", f"SELECT *, {picked('product', 'np')} AS product_id FROM chosen")
        ctes = ctes.add("dated", day)
        price = f"{lognormal('products', 'base_price', 3.0, 0.8, 'product_id')} * {lognormal('orders', 'price', 0.0, 0.12)}"
        quantity = f"least(ceil(ln({unit(rolled('orders', 'quantity'))}) / ln(1::DOUBLE - 0.42::DOUBLE)), 12)::DOUBLE"
        return ctes.select(
            "SELECT id AS order_id, customer_id, product_id,"
            " strftime(TIMESTAMP '2024-01-01' + to_days(day::INTEGER), '%Y-%m-%d') AS order_date,"
            f" {quantity} AS quantity, {r(price)} AS unit_price,"
            f" {categorical(unit(rolled('orders', 'discount')), gen.DISCOUNTS)} AS discount,"
            f" {categorical(unit(rolled('orders', 'status')), gen.STATUSES)} AS status FROM dated"
        )

    any_day = f"SELECT *, {plain_day} AS day FROM goods"
    season_day = (
        f"SELECT g.*, day FROM (SELECT *, {unit(rolled('orders', 'day'))} AS s FROM goods) g"
        f" JOIN {season} AS t(low, high, day) ON s >= low AND s < high"
    )
    return {
        "gen_customers": customers,
        "gen_products": products,
        "gen_orders_uniform": orders(even_customers, any_day),
        "gen_orders_skewed": orders(zipf, any_day),
        "gen_orders_seasonal": orders(even_customers, season_day),
    }


def workload_sql() -> dict[str, str]:
    done = "status = 'completed'"
    fc, fp = "fact JOIN cust USING (customer_id)", "fact JOIN prod USING (product_id)"

    def group(key: str, name: str, value: str, alias: str, source: str, where: str = "true") -> str:
        return STAR.select(f"SELECT {key} AS {name}, {r(value, 4)} AS {alias} FROM {source} WHERE {where} GROUP BY 1")

    total = f"sum({NET})"
    direct = []
    for q in _texts():
        sql = q.sql.replace("FROM orders", "FROM fact").replace("JOIN customers", "JOIN cust").replace("JOIN products", "JOIN prod")
        key = "concat_ws('|', " + ", ".join(q.keys) + ")" if q.keys else "''"
        for v in q.values:
            direct.append(f"SELECT '{q.name}' AS query, {key} AS key, '{v}' AS measure, {r(v)} AS value FROM ({sql})")
    return {
        "revenue_region": group("region", "region", total, "revenue", fc, done),
        "revenue_month": group("strftime(date_trunc('month', order_date), '%Y-%m-%d')", "month", total, "revenue", "fact", done),
        "revenue_category": group("category", "category", total, "revenue", fp, done),
        "aov_segment": group("segment", "segment", f"avg({NET})", "avg_value", fc, done),
        "refund_region": group("region", "region", "avg(CASE WHEN status = 'refunded' THEN 1.0 ELSE 0.0 END)", "refund_rate", fc),
        "orders_status": group("status", "status", "count(*)", "order_count", "fact"),
        "customers_region": group("region", "region", "count(DISTINCT customer_id)", "customers", fc),
        "daily_revenue": group("strftime(order_date, '%Y-%m-%d')", "day", total, "revenue", "fact", done),
        "workload_direct": STAR.select(" UNION ALL ".join(direct)),
    }


def choice_sql() -> dict[str, str]:
    again = copies("again", [(0, 1.0, ("again", cfg.SEED))], "fact", "order_id")
    drift = STAR.add_all(hits([(0, cfg.SEVERITY, 0)]))
    return {
        "dense_ids": f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS order_id, l_orderkey, l_linenumber,"
        " l_partkey, l_suppkey FROM lineitem",
        "exact_sample": STAR.select(
            "SELECT order_id, status FROM (SELECT *, row_number() OVER (ORDER BY "
            + roll("order_id", seed_words("exact", cfg.SEED))
            + ", order_id) AS place, count(*) OVER () AS n FROM fact) WHERE place <= "
            + hit_count(cfg.SEVERITY, "n")
        ),
        "sample_with_replacement": STAR.add_all(again).select("SELECT order_id, k AS times FROM again"),
        "hash_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY "
        + roll("event_id", seed_words("hash", cfg.SEED))
        + f", event_id LIMIT {cfg.HASH_SAMPLE}",
        "drift_impact": drift.select(
            "SELECT count(*)::BIGINT AS impacted_orders, count(DISTINCT customer_id)::BIGINT AS customers_with_orders"
            " FROM fact WHERE customer_id IN (SELECT customer_id FROM ch WHERE hit_dd)"
        ),
        "orphan_audit": drift.select(
            "SELECT status, count(*)::BIGINT AS orphans, min(-(order_id + 1))::BIGINT AS lowest,"
            " max(-(order_id + 1))::BIGINT AS highest FROM oh WHERE hit_fk GROUP BY 1"
        ),
    }


def channel_sql() -> dict[str, str]:
    base = STAR.add_all(hits([(0, cfg.SEVERITY, 0)]))
    price = f"{r('quantity * unit_price', 4)} AS amount"

    def rows(customer: str = "customer_id", when: str = "order_date", price: str = price, source: str = "oh") -> str:
        return base.select(
            f"SELECT order_id, {customer} AS customer_id, strftime({when}, '%Y-%m-%d') AS order_date, {price}, status FROM {source}"
        )

    lost = r("CASE WHEN hit_mm THEN NULL ELSE quantity * unit_price END", 4) + " AS amount"
    noisy = r("quantity * CASE WHEN hit_vn THEN unit_price * factor ELSE unit_price END", 4) + " AS amount"
    both = (
        r("quantity * CASE WHEN hit_mm THEN NULL WHEN hit_vn THEN unit_price * factor ELSE unit_price END", 4) + " AS amount"
    )
    stale = "CASE WHEN hit_ts THEN order_date - INTERVAL 365 DAY ELSE order_date END"
    orphan = "CASE WHEN hit_fk THEN -(order_id + 1) ELSE customer_id END"
    more = "(SELECT o.* FROM oh o UNION ALL SELECT o.* FROM (SELECT order_id, unnest(range(k)) FROM dup) JOIN oh o USING (order_id))"
    moved = "SELECT customer_id, CASE WHEN hit_dd THEN next_region ELSE region END AS region, segment FROM ch"
    reach = base_repeats().select(
        "SELECT severity, repeat::INTEGER AS repeat, channel, kind, affected, CASE channel WHEN 'value_noise' THEN 1::DOUBLE"
        f" WHEN 'stale_timestamps' THEN 365::DOUBLE END AS setting, {r('affected::DOUBLE / size')} AS realized_rate, impacted_orders, linked_orders,"
        f" {r('impacted_orders::DOUBLE / affected')} AS fact_amplification FROM ("
        + " UNION ALL ".join(
            f"SELECT severity, repeat, '{name}' AS channel, '{kind}' AS kind, {hit_count('severity', size)} AS affected,"
            f" {size} AS size, {'touched' if name == 'dimension_drift' else '0'}::BIGINT AS impacted_orders,"
            f" {'linked' if name == 'dimension_drift' else '0'}::BIGINT AS linked_orders"
            " FROM scen, sizes JOIN (SELECT sid AS x, count(*)::BIGINT AS touched, count(*) FILTER (WHERE NOT hit_fk)::BIGINT AS linked"
            " FROM oh JOIN ch USING (sid, customer_id) WHERE hit_dd GROUP BY 1) ON x = sid"
            for name, kind, size in [
                (n, "customers" if n == "dimension_drift" else "added" if n == "duplicate_facts" else "orders",
                 "n_cust" if n == "dimension_drift" else "n_fact")
                for n in cfg.CHANNELS
            ]
        )
        + ")"
    )
    return {
        "chan_missing_measures": rows(price=lost),
        "chan_value_noise": rows(price=noisy),
        "chan_orphan_fk": rows(customer=orphan),
        "chan_stale_ts": rows(when=stale),
        "chan_duplicate_facts": rows(source=more),
        "chan_dimension_drift": base.select(moved),
        "chan_all_composed": base.select(
            f"SELECT order_id, {orphan} AS customer_id, CASE WHEN hit_fk THEN NULL ELSE c.region END AS region,"
            f" strftime({stale}, '%Y-%m-%d') AS order_date, {both}, status FROM {more} o JOIN ({moved}) c USING (customer_id)"
        ),
        "dup_facts": base.select("SELECT order_id, k + 1 AS copies FROM dup"),
        "channel_diagnostics": reach,
    }


def base_repeats() -> Ctes:
    return STAR.add_all(hits([(i, cfg.SEVERITY, i) for i in range(cfg.REPEATS)]))


def surface_sql() -> dict[str, str]:
    full = 63
    # the damaged answers of the full combination against the clean ones
    per_query = f"SELECT query, {r('loss')} AS loss FROM losses WHERE mask = {full}"
    names = sorted((n, 1 << i) for i, n in enumerate(cfg.CHANNELS))
    listed = "list_filter([" + ", ".join(f"CASE WHEN mask & {b} <> 0 THEN '{n}' END" for n, b in names) + "], lambda x: x IS NOT NULL)"
    key = f"CASE WHEN mask = 0 THEN 'EMPTY' ELSE array_to_string({listed}, '|') END"
    global_totals = f"sum(w * {NET}) AS revenue, sum(w)::DOUBLE AS n"

    def err(v: str) -> str:
        return f"least(1, abs(b.{v} - a.{v}) / (abs(a.{v}) + 1e-12))"

    dose = surface(STAR, cfg.DOSES, range(cfg.DOSE_REPEATS), cfg.DOSE_CHANNELS)
    dose = accounts(dose, "risks", "severity", cfg.DOSE_CHANNELS)
    dose = boot(dose, "risks", list(range(cfg.DOSE_REPEATS)), "severity", cfg.DOSE_CHANNELS)
    checks = []
    for column, op, constant in cfg.EVIDENCE:
        sql_op = "=" if op == "==" else op
        checks.append(
            f"SELECT '{column} {op} {constant:g}' AS \"check\", {r(column)} AS value,"
            f" ({column}::DOUBLE {sql_op} {float(constant)!r}::DOUBLE) AS passed FROM v"
        )
    status = "query = 'orders_status'"
    evidence = LINES.add(
        "v",
        "SELECT count(*) AS cells, max(loss) AS largest_loss, max(CASE WHEN mask = 0 THEN loss END) AS clean_loss,"
        f" max(CASE WHEN {status} AND mask = 32 THEN loss END) AS status_copies,"
        f" max(CASE WHEN {status} AND mask = 1 THEN loss END) AS missing_on_status FROM losses",
    )
    return {
        "answer_alignment": ONE.select(
            f"SELECT key AS day, {r('ref', 4)} AS revenue_ref, {r('obs', 4)} AS revenue_obs FROM aligned"
            f" WHERE query = 'daily_revenue' AND mask = {full}"
        ),
        "answer_loss": ONE.select(per_query),
        "answer_loss_global": ONE.select(
            f"SELECT {r(f'({err("revenue")} + {err("n")}) / 2')} AS loss FROM"
            f" (SELECT {global_totals} FROM hurt WHERE mask = 0) a, (SELECT {global_totals} FROM hurt WHERE mask = {full}) b"
        ),
        "answer_loss_multi": ONE.add_all(
            [
                (
                    "multi",
                    "SELECT mask, region, status, sum(w)::DOUBLE AS n, sum(w * discount) / sum(w) AS d FROM hurt"
                    f" WHERE mask IN (0, {full}) AND NOT orphan GROUP BY ALL",
                )
            ]
        ).select(
            f"SELECT {r('(least(1, sum(abs(coalesce(b.n, 0) - coalesce(a.n, 0))) / (sum(abs(coalesce(a.n, 0))) + 1e-12))'
              ' + least(1, sum(abs(coalesce(b.d, 0) - coalesce(a.d, 0))) / (sum(abs(coalesce(a.d, 0))) + 1e-12))) / 2')} AS loss"
            f" FROM (SELECT * FROM multi WHERE mask = 0) a FULL JOIN (SELECT * FROM multi WHERE mask = {full}) b"
            " ON a.region = b.region AND a.status = b.status"
        ),
        "workload_risk": ONE.select(
            f"SELECT {r('0.75 * max(CASE WHEN query = \'revenue_region\' THEN loss END) OVER ()'
              ' + 0.25 * max(CASE WHEN query = \'daily_revenue\' THEN loss END) OVER ()')} AS risk, query,"
            f" {r('loss')} AS loss FROM losses WHERE mask = {full}"
        ),
        "risk_surface": LINES.select(
            f"SELECT severity, repeat::INTEGER AS repeat, query, mask, {r('loss')} AS loss FROM losses"
        ),
        "direct_risk_surface": LINES.add_all(
            [
                (
                    "texts",
                    "SELECT sid, repeat, mask, 'status_by_region' AS query, region || '|' || status AS key, 'n' AS measure, sum(w)::DOUBLE AS v"
                    " FROM hurt WHERE NOT orphan GROUP BY ALL UNION ALL"
                    " SELECT sid, repeat, mask, 'status_by_region', region || '|' || status, 'd', sum(w * discount) / sum(w)"
                    " FROM hurt WHERE NOT orphan GROUP BY ALL UNION ALL"
                    " SELECT sid, repeat, mask, 'all_quantity', '', 'q', sum(w * quantity) FROM hurt WHERE status <> 'cancelled' GROUP BY ALL"
                    " UNION ALL SELECT sid, repeat, mask, 'list_price', h.category, 'top', max(base_price)"
                    " FROM hurt h JOIN prod USING (product_id) GROUP BY ALL",
                ),
                (
                    "text_pairs",
                    "SELECT repeat, query, measure, mask, key, sum(ref) AS ref, sum(obs) AS obs FROM ("
                    "SELECT repeat, query, measure, m.mask, key, v AS ref, 0 AS obs FROM texts t, masks m WHERE t.mask = 0"
                    " UNION ALL SELECT repeat, query, measure, mask, key, 0, v FROM texts) GROUP BY ALL",
                ),
                (
                    "text_losses",
                    "SELECT repeat, query, measure, mask, least(1, sum(abs(obs - ref)) / (sum(abs(ref)) + 1e-12)) AS loss"
                    " FROM text_pairs GROUP BY ALL",
                ),
            ]
        ).select(
            f"SELECT {cfg.SEVERITY}::DOUBLE AS severity, repeat::INTEGER AS repeat, query, mask::BIGINT AS mask, {r('avg(loss)')} AS loss"
            " FROM text_losses GROUP BY ALL"
        ),
        "risk_observations": LINES.add_all(
            [
                (
                    "reach",
                    "SELECT repeat, count(*)::BIGINT AS touched, count(*) FILTER (WHERE NOT hit_fk)::BIGINT AS linked"
                    " FROM oh JOIN ch USING (sid, customer_id) WHERE hit_dd GROUP BY ALL",
                )
            ]
        ).select(
            f"SELECT repeat::INTEGER AS repeat, {key} AS coalition_key, bit_count(mask)::INTEGER AS coalition_size,"
            f" {r('avg(loss)')} AS loss, any_value(n_fact)::BIGINT AS orders,"
            f" {r('max(CASE WHEN query = \'daily_revenue\' THEN loss END)')} AS daily_loss,"
            " any_value(CASE WHEN mask & 16 = 0 THEN 0 WHEN mask & 4 <> 0 THEN linked ELSE touched END)::BIGINT AS impacted_orders"
            " FROM losses JOIN reach USING (repeat), sizes GROUP BY repeat, mask"
        ),
        "result_files": LINES.select(
            f"SELECT repeat::INTEGER AS repeat, mask::BIGINT AS mask, {r('avg(loss)')} AS loss, bit_count(mask)::INTEGER AS members,"
            f" {r('max(CASE WHEN query = \'daily_revenue\' THEN loss END)')} AS daily_loss FROM losses GROUP BY 1, 2, mask"
        ),
        "coalition_masks": LINES.select(f"SELECT mask::BIGINT AS mask, {key} AS coalition_key, {r('value')} AS value FROM game"),
        "coalition_means": LINES.select(f"SELECT {key} AS coalition_key, {r('value')} AS value FROM game"),
        "design_check": LINES.select(
            "SELECT query, count(*)::BIGINT AS rows, count(DISTINCT repeat * 64 + mask)::BIGINT AS cells,"
            " (count(DISTINCT repeat) * 64)::BIGINT AS expected, count(*) FILTER (WHERE loss IS NULL)::BIGINT AS holes,"
            " (count(*) = count(DISTINCT repeat * 64 + mask) AND count(*) = count(DISTINCT repeat) * 64"
            " AND count(*) FILTER (WHERE loss IS NULL) = 0) AS complete FROM losses GROUP BY 1"
        ),
        "evidence_checks": evidence.select(" UNION ALL ".join(checks)),
        "dose_response": estimates(dose, "severity"),
        "prefix_coalitions": LINES.add_all([players(), *orders_cte("8")]).select(
            f"SELECT repeat::INTEGER AS repeat, mask, {r('avg(loss)')} AS loss FROM losses WHERE mask IN"
            " (SELECT mask FROM walk UNION SELECT before FROM walk) GROUP BY 1, 2"
        ),
    }


def populations() -> Ctes:
    """CTE ``prisks`` (regime, repeat, mask, loss) of both populations, from two nested surfaces."""
    lines = surface(STAR, [cfg.SEVERITY], range(cfg.EVENT_REPEATS)).select("SELECT repeat, mask, loss FROM risks")
    events = surface(EVENTS, [cfg.SEVERITY], range(cfg.EVENT_REPEATS)).select("SELECT repeat, mask, loss FROM risks")
    return Ctes(
        ("lrisks", lines),
        ("erisks", events),
        ("prisks", "SELECT 'lines' AS regime, * FROM lrisks UNION ALL SELECT 'events', * FROM erisks"),
    )


def attribution_sql() -> dict[str, str]:
    whole = accounts(LINES, "risks")
    booted = boot(whole, "risks", list(range(cfg.REPEATS)))
    by_query = boot(accounts(LINES, "losses", "query"), "losses", list(range(cfg.REPEATS)), "query")
    pops = boot(accounts(populations(), "prisks", "regime"), "prisks", list(range(cfg.EVENT_REPEATS)), "regime")
    only_events = Ctes(
        ("erisks", surface(EVENTS, [cfg.SEVERITY], range(cfg.EVENT_REPEATS)).select("SELECT repeat, mask, loss FROM risks")),
        ("prisks", "SELECT 'events' AS regime, * FROM erisks"),
    )
    only_events = boot(
        accounts(only_events, "prisks", "regime"), "prisks", list(range(cfg.EVENT_REPEATS)), "regime"
    )
    size, m = cfg.REPEATS, len(cfg.CHANNELS)
    rolled = roll("i", seed_words("bootstrap", cfg.SEED, "unpaired"))
    ablation = booted.add_all(
        [
            (
                "picks",
                f"SELECT i // {size << m} AS draw, (i // {size}) % {1 << m} AS mask, ({rolled} * {size}) >> 31 AS repeat"
                f" FROM range({cfg.DRAWS * (size << m)}) AS t(i)",
            ),
            ("umean", "SELECT draw, mask, avg(loss) AS value FROM picks JOIN risks USING (repeat, mask) GROUP BY ALL"),
            (
                "uphi",
                "SELECT a.draw, idx, player, sum(factorial(bit_count(a.mask)::INTEGER)::DOUBLE"
                f" * factorial(({m} - bit_count(a.mask) - 1)::INTEGER)::DOUBLE / factorial({m})::DOUBLE * (b.value - a.value)) AS debt"
                " FROM umean a, players, umean b WHERE a.mask & bit = 0 AND b.mask = a.mask | bit AND a.draw = b.draw GROUP BY ALL",
            ),
            (
                "widths",
                "SELECT player AS channel, ci_high - ci_low AS paired_width, u AS unpaired_width, (ci_high - ci_low) / u AS ratio"
                " FROM intervals JOIN (SELECT player, quantile_cont(debt, 0.975) - quantile_cont(debt, 0.025) AS u FROM uphi"
                " GROUP BY 1) USING (player)",
            ),
        ]
    )
    phi = "FROM phi"
    return {
        "coalition_completeness": LINES.add_all([players(), *orders_cte("8")]).select(
            f"SELECT mask, 'missing' AS problem FROM ({every_mask(m)}) WHERE mask NOT IN"
            " (SELECT mask FROM walk UNION SELECT before FROM walk) AND mask IN (SELECT mask FROM game)"
        ),
        "marginal_contributions": whole.select(f"SELECT player, mask, size::INTEGER AS size, {r('marginal')} AS marginal FROM marg"),
        "shapley_exact": whole.select(f"SELECT player, {r('debt')} AS debt {phi}"),
        "banzhaf": whole.select(f"SELECT player, {r('banzhaf')} AS banzhaf {phi}"),
        "shapley_interactions": whole.add_all([interactions()]).select(
            f'SELECT "left", "right", {r("interaction")} AS interaction FROM pairs'
        ),
        "singleton_gain": whole.select(
            f"SELECT player, {r('singleton')} AS singleton, {r('current_gain')} AS current_gain {phi}"
        ),
        "debt_accounting": whole.add_all([accounting()]).select(
            f"SELECT {', '.join(f'{r(c)} AS {c}' for c in TOTALS)} FROM totals"
        ),
        "attribution": estimates(booted),
        "query_attribution": estimates(by_query, "query"),
        "repair_decision": whole.add_all([decisions()]).select(
            f"SELECT shapley_choice, singleton_choice, oracle_choice, {', '.join(f'{r(c)} AS {c}' for c in GAINS)} FROM decided"
        ),
        "study_summary": summary(booted, cfg.REPEATS),
        "snapshot_study": summary(only_events, cfg.EVENT_REPEATS, "regime"),
        "all_populations": estimates(pops, "regime"),
        "accounting_vs_gain": accounts(populations(), "prisks", "regime").select(
            f"SELECT regime, player AS channel, {r('debt')} AS debt, {r('current_gain')} AS repair_gain {phi}"
        ),
        "bootstrap_draws": booted.select(
            "SELECT draw, mask, count(*)::BIGINT AS slots, min(repeat)::INTEGER AS first_repeat, max(repeat)::INTEGER AS last_repeat,"
            f" {r('avg(loss)')} AS value FROM slots JOIN risks USING (repeat) GROUP BY 1, 2"
        ),
        "bootstrap_shapley": booted.select(f"SELECT draw, player, {r('debt')} AS debt, {r('gain')} AS gain FROM bphi"),
        "bootstrap_intervals": booted.select(
            "SELECT player, " + ", ".join(f"{r(c)} AS {c}" for c in ("ci_low", "ci_high", "gain_ci_low", "gain_ci_high"))
            + " FROM intervals"
        ),
        "rank_probability": booted.select(
            f"SELECT player, {r('probability_harmful')} AS probability_harmful, {r('rank_1_probability')} AS rank_1_probability"
            " FROM intervals"
        ),
        "paired_ablation": ablation.select(
            f"SELECT channel, {r('paired_width')} AS paired_width, {r('unpaired_width')} AS unpaired_width,"
            f" {r('ratio', 4)} AS paired_unpaired_ratio FROM widths"
        ),
        "paired_ratio_summary": ablation.select(
            f'SELECT {r("quantile_cont(ratio, 0.5)", 4)} AS median, {r("min(ratio)", 4)} AS "min", {r("max(ratio)", 4)} AS "max" FROM widths'
        ),
    }


def sampling_sql() -> dict[str, str]:
    whole = accounts(LINES, "risks")
    plain = whole.add_all([*orders_cte(str(cfg.ORDERS)), CONTRIB])
    paired = whole.add_all([*orders_cte(str(cfg.ORDERS), True), CONTRIB])
    m = len(cfg.CHANNELS)
    path = f"SELECT draw, position, player, {r('value')} AS value FROM walk JOIN g USING (mask)"
    starts, total = [], 0
    for budget in cfg.BUDGETS:
        starts.append((budget, total, total + budget * cfg.TRIALS))
        total += budget * cfg.TRIALS
    draws = (
        f"SELECT i AS draw, b AS permutations, (i - low) // b AS trial, {order_radius(m, 'b')} AS radius"
        f" FROM range({total}) AS t(i) JOIN {values(starts)} AS s(b, low, high) ON i >= low AND i < high"
    )
    trials = whole.add_all([*orders_cte("", False, draws), CONTRIB]).add_all(
        [
            (
                "sampled",
                "SELECT permutations, trial, radius, idx, player, avg(contribution) AS value FROM contrib GROUP BY ALL",
            ),
            (
                "scored",
                "SELECT permutations, trial, radius, sqrt(avg(pow(value - debt, 2))) AS rmse, max(abs(value - debt)) AS max_error,"
                " arg_max(s.idx, {'s': value, 'i': -s.idx}) = arg_max(s.idx, {'s': debt, 'i': -s.idx}) AS top1"
                " FROM sampled s JOIN phi USING (player) GROUP BY ALL",
            ),
            (
                "coverage",
                "SELECT permutations, trial, count(DISTINCT mask) AS n FROM (SELECT permutations, trial, mask FROM walk"
                " UNION ALL SELECT permutations, trial, before FROM walk) GROUP BY ALL",
            ),
            ("trials", "SELECT * FROM scored JOIN coverage USING (permutations, trial)"),
        ]
    )
    error = f"stddev_samp(contribution) / sqrt({cfg.ORDERS}::DOUBLE)"
    half = cfg.ORDERS // 2
    return {
        "permutation_orders": plain.select(path),
        "antithetic_orders": paired.select(path),
        "permutation_prefixes": plain.select(
            f"SELECT draw, position, player, w.mask, before, {r('value')} AS value FROM walk w JOIN g ON w.mask = g.mask"
        ),
        "permutation_marginals": plain.select(
            f"SELECT draw, position, player, {r('contribution')} AS contribution FROM contrib"
        ),
        "permutation_shapley": plain.select(
            f"SELECT player, {r('avg(contribution)')} AS value, {r(error)} AS standard_error,"
            f" {r(order_radius(m, cfg.ORDERS))} AS hoeffding_radius FROM contrib GROUP BY 1"
        ),
        "antithetic_shapley": paired.select(
            f"SELECT player, {r('avg(c)')} AS value, {r(f'stddev_samp(c) / sqrt({half}::DOUBLE)')} AS standard_error,"
            f" {r(order_radius(m, half))} AS hoeffding_radius"
            " FROM (SELECT draw // 2 AS pair, player, avg(contribution) AS c FROM contrib GROUP BY ALL) GROUP BY 1"
        ),
        "permutation_coverage": plain.select(
            f"SELECT {cfg.ORDERS}::INTEGER AS samples, count(*)::BIGINT AS unique_coalitions, 64::BIGINT AS exact_coalitions,"
            f" {r('sum(value)')} AS seen_value FROM g WHERE mask IN (SELECT mask FROM walk UNION SELECT before FROM walk)"
        ),
        "convergence_trials": trials.select(
            f"SELECT permutations::INTEGER AS permutations, trial::INTEGER AS trial, {r('rmse')} AS rmse,"
            f" {r('max_error')} AS max_error, top1, n::BIGINT AS unique_coalitions, 64::BIGINT AS exact_coalitions,"
            f" {r('n / 64::DOUBLE')} AS coalition_fraction, {r('radius')} AS hoeffding_radius FROM trials"
        ),
        "convergence_summary": trials.select(
            f"SELECT permutations::INTEGER AS permutations, {r('quantile_cont(rmse, 0.5)')} AS rmse_median,"
            f" {r('quantile_cont(rmse, 0.1)')} AS rmse_low, {r('quantile_cont(rmse, 0.9)')} AS rmse_high,"
            f" {r('avg(top1::INTEGER)')} AS top1, {r('avg(n / 64::DOUBLE)')} AS coalition_fraction FROM trials GROUP BY 1"
        ),
    }


def wide_sql() -> dict[str, str]:
    """Twelve defects: every order damaged under each combination that a few random orders pass."""
    m, repeats = len(cfg.WIDE_CHANNELS), range(cfg.REPEATS)
    bits = {name: 1 << i for i, name in enumerate(cfg.WIDE_CHANNELS)}
    base = STAR.add_all(hits([(i, cfg.SEVERITY, i) for i in repeats]))
    more = cfg.WIDE_CHANNELS[len(cfg.CHANNELS) :]
    streams = [(name,) for name in more] + [("mild_noise", "radius"), ("mild_noise", "angle")]
    names = [*more, "mild_radius", "mild_angle"]
    rows = [(i, *[w for s in streams for w in defect_seeds(i, *s)]) for i in repeats]
    seeds = f"{values(rows)} AS t(sid, {', '.join(f'{n}{i}' for n in names for i in (0, 1))})"
    flags = ", ".join(
        f"row_number() OVER (PARTITION BY sid ORDER BY {roll('order_id', (n + '0', n + '1'))}, order_id)"
        f" <= {hit_count(cfg.SEVERITY, 'n_fact')} AS hit_{n}"
        for n in more
    )
    mild = normal(roll("order_id", ("mild_radius0", "mild_radius1")), roll("order_id", ("mild_angle0", "mild_angle1")))

    def on(name: str, flag: str | None = None) -> str:
        return f"(mask & {bits[name]} <> 0 AND {flag or 'hit_' + name})"

    price = f"CASE WHEN {on('missing_measures', 'hit_mm')} THEN NULL WHEN {on('value_noise', 'hit_vn')} THEN unit_price * factor ELSE unit_price END"
    base = base.add_all(
        [
            players(cfg.WIDE_CHANNELS),
            *orders_cte(str(cfg.WIDE_ORDERS), m=m),
            ("masks", "SELECT mask FROM walk UNION SELECT before FROM walk"),
            ("wh", f"SELECT oh.*, {flags}, exp(0.25::DOUBLE * {mild}) AS mild FROM oh JOIN {seeds} USING (sid), sizes"),
            (
                "priced",
                f"SELECT o.sid, severity, repeat, mask, o.order_id, o.customer_id, hit_cut_prices, ({price})"
                f" * CASE WHEN {on('mild_noise')} THEN mild ELSE 1 END AS unit_price,"
                f" CASE WHEN {on('unit_mixup')} THEN quantity * 10 ELSE quantity END AS quantity,"
                f" CASE WHEN {on('lost_discounts')} THEN 0 ELSE discount END AS discount,"
                f" CASE WHEN {on('wrong_refunds')} THEN 'refunded' ELSE status END AS status,"
                f" {on('orphan_foreign_keys', 'hit_fk')} AS orphan, order_date"
                f" - CASE WHEN {on('stale_timestamps', 'hit_ts')} THEN INTERVAL 365 DAY ELSE INTERVAL 0 DAY END"
                f" - CASE WHEN {on('late_week')} THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS order_date,"
                f" CASE WHEN {on('dimension_drift', 'hit_dd')} THEN next_region ELSE region END AS region, segment, category,"
                f" CASE WHEN mask & {bits['duplicate_facts']} <> 0 THEN 1 + coalesce(k, 0) ELSE 1 END AS w"
                " FROM wh o JOIN ch USING (sid, customer_id) JOIN prod USING (product_id)"
                " LEFT JOIN dup ON o.sid = dup.sid AND o.order_id = dup.order_id, masks",
            ),
            ("hurt", f"SELECT * REPLACE (CASE WHEN {on('cut_prices')} THEN floor(unit_price) ELSE unit_price END AS unit_price) FROM priced"),
        ]
    ).add_all(losses())
    error = f"stddev_samp(contribution) / sqrt({cfg.WIDE_ORDERS}::DOUBLE)"
    return {
        "wide_surface": base.select(f"SELECT repeat::INTEGER AS repeat, query, mask, {r('loss')} AS loss FROM losses"),
        "wide_shapley": base.add_all([game_of("risks"), CONTRIB]).select(
            f"SELECT player, {r('avg(contribution)')} AS value, {r(error)} AS standard_error,"
            f" {r(order_radius(m, cfg.WIDE_ORDERS))} AS hoeffding_radius FROM contrib GROUP BY 1"
        ),
    }


FEATURES = ("quantity", "discount", "tax", "part_size", "retail_price")
PRICES = Ctes(
    (
        "feats",
        f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_id, l_quantity::DOUBLE AS quantity,"
        " l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, p_size::DOUBLE AS part_size,"
        " p_retailprice::DOUBLE AS retail_price, l_extendedprice::DOUBLE AS label"
        " FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
)


def model_seeds(name: str, stream: str = "hit") -> tuple[int, int]:
    return seed_words("features", cfg.MODEL_MASTER, 0, name, stream)


def cell_hits(name: str) -> tuple[str, str]:
    """CTE ``cells_<name>`` (row_id, j): the hit cells."""
    key = f"row_id * {len(FEATURES)} + j"
    return (
        f"cells_{name}",
        f"SELECT row_id, j FROM (SELECT row_id, j, row_number() OVER (ORDER BY {roll(key, model_seeds(name))}, {key}) AS place,"
        f" count(*) OVER () AS n FROM feats, range({len(FEATURES)}) AS t(j)) WHERE place <= {hit_count(cfg.MODEL_SEVERITY, 'n')}",
    )


def row_hits(name: str, table: str) -> str:
    return (
        f"SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {roll('row_id', model_seeds(name))}, row_id) AS place,"
        f" count(*) OVER () AS n FROM {table}) WHERE place <= {hit_count(cfg.MODEL_SEVERITY, 'n')}"
    )


def wide(name: str) -> str:
    """Hit flags per row, one column per feature."""
    flags = ", ".join(f"bool_or(j = {i}) AS hit_{c}" for i, c in enumerate(FEATURES))
    return f"SELECT row_id, {flags} FROM cells_{name} GROUP BY 1"


def ridge(base: Ctes, train: str, test: str, keys: tuple[str, ...]) -> Ctes:
    """Adds ``ridge_loss`` (keys, loss, n): the regression on filled and scaled columns in closed form, scored on ``test``."""
    k, d = ", ".join(keys), len(FEATURES)
    scaled = {c: f"(coalesce({c}, med_{c}, 0) - m_{c}) / s_{c}" for c in FEATURES}
    products = [
        f"sum(z_{FEATURES[i]} * z_{FEATURES[j]}) + {float(i == j)!r}::DOUBLE AS a{i}{j}" for i in range(d) for j in range(d)
    ]
    base = base.add_all(
        [
            ("med", f"SELECT {k}, {', '.join(f'quantile_cont({c}, 0.5) AS med_{c}' for c in FEATURES)} FROM {train} GROUP BY ALL"),
            (
                "spread",
                f"SELECT {k}, count(*)::BIGINT AS n, avg(label) AS m_label, "
                + ", ".join(
                    f"avg(coalesce({c}, med_{c}, 0)) AS m_{c}, CASE WHEN stddev_pop(coalesce({c}, med_{c}, 0)) > 1e-12"
                    f" THEN stddev_pop(coalesce({c}, med_{c}, 0)) ELSE 1 END AS s_{c}"
                    for c in FEATURES
                )
                + f" FROM {train} JOIN med USING ({k}) GROUP BY {k}",
            ),
            (
                "z",
                f"SELECT {k}, {', '.join(f'{e} AS z_{c}' for c, e in scaled.items())}, label - m_label AS z_label"
                f" FROM {train} JOIN med USING ({k}) JOIN spread USING ({k})",
            ),
            (
                "solve_0",
                f"SELECT {k}, {', '.join(products)}, {', '.join(f'sum(z_{c} * z_label) AS b{i}' for i, c in enumerate(FEATURES))}"
                f" FROM z GROUP BY {k}",
            ),
        ]
    )
    for p in range(d):  # one column after the other
        cells = [
            f"a{i}{j} / a{p}{p} AS a{i}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}"
            for i in range(d)
            for j in range(p + 1, d)
        ]
        ends = [f"b{i} / a{p}{p} AS b{i}" if i == p else f"b{i} - a{i}{p} * b{p} / a{p}{p} AS b{i}" for i in range(d)]
        base = base.add(f"solve_{p + 1}", f"SELECT {k}, {', '.join(cells + ends)} FROM solve_{p}")
    predicted = " + ".join(["m_label", *[f"b{i} * {e}" for i, e in enumerate(scaled.values())]])
    iqr = "quantile_cont(label, 0.75) - quantile_cont(label, 0.25)"
    return base.add_all(
        [
            ("units", f"SELECT {k}, CASE WHEN {iqr} > 1e-12 THEN {iqr} ELSE stddev_pop(label) END AS unit FROM {test} GROUP BY ALL"),
            (
                "ridge_loss",
                f"SELECT {k}, avg(least(abs({predicted} - label) / unit, 1)) AS loss, any_value(n) AS n FROM {test}"
                f" JOIN solve_{d} USING ({k}) JOIN med USING ({k}) JOIN spread USING ({k}) JOIN units USING ({k}) GROUP BY {k}",
            ),
        ]
    )


def ridge_surface(base: Ctes, master: int, repeats: int, severity: float = cfg.MODEL_SEVERITY) -> Ctes:
    """Adds ``ridge_loss`` (repeat, mask, loss, n) for CTE ``feats``: each combination's training rows, damaged one by one."""
    kinds = [("sp", None, None)]
    kinds += [("mc", "missing_cells", "hit"), ("fn", "feature_noise", "hit"), ("fr", "feature_noise", "radius"), ("fa", "feature_noise", "angle")]
    kinds += [("tn", "target_noise", "hit"), ("tr", "target_noise", "radius"), ("ta", "target_noise", "angle")]
    rows = [
        (i, *[w for _, name, stream in kinds for w in (seed_words("features", master, i, name, stream) if name else seed_words("split", master, i))])
        for i in range(repeats)
    ]
    width = len(FEATURES)
    seeds = ", ".join(f"{n}{i}" for n, _, _ in kinds for i in (0, 1))

    def first(key: str, n: str, count: str) -> str:
        return f"row_number() OVER (PARTITION BY repeat ORDER BY {roll(key, (n + '0', n + '1'))}, {key}) <= {count}"

    size = "count(*) OVER (PARTITION BY repeat)"
    hit = hit_count(severity, size)
    cell = f"(row_id * {width} + j)"
    z = {c: normal(roll(f"(row_id * {width} + {j})", ("fr0", "fr1")), roll(f"(row_id * {width} + {j})", ("fa0", "fa1"))) for j, c in enumerate(FEATURES)}
    flags = ", ".join(f"bool_or(lost) FILTER (j = {j}) AS lost_{c}, bool_or(noisy) FILTER (j = {j}) AS noisy_{c}" for j, c in enumerate(FEATURES))
    copied: list[tuple[str, str]] = []
    for i in range(repeats):
        copied.append((f"train_{i}", f"SELECT row_id FROM clean WHERE repeat = {i}"))
        copied += copies(f"again_{i}", [(0, severity, ("features", master, i, "duplicate_rows"))], f"train_{i}", "row_id")
    again = " UNION ALL ".join(f"SELECT {i} AS repeat, row_id, k FROM again_{i}" for i in range(repeats))

    def guarded(text: str) -> str:
        return f"CASE WHEN {text} > 1e-12 THEN {text} ELSE 1 END"

    deviations = ", ".join(f"{guarded(f'stddev_pop({c})')} AS sd0_{c}, {guarded(f'stddev_pop(CASE WHEN NOT lost_{c} THEN {c} END)')} AS sd1_{c}" for c in FEATURES)
    damaged_cells = ", ".join(
        f"CASE WHEN mask & 1 <> 0 AND lost_{c} THEN NULL ELSE {c} + CASE WHEN mask & 2 <> 0 AND noisy_{c}"
        f" THEN 3::DOUBLE * CASE WHEN mask & 1 <> 0 THEN sd1_{c} ELSE sd0_{c} END * z_{c} ELSE 0 END END AS {c}"
        for c in FEATURES
    )
    shifted = "label + CASE WHEN mask & 4 <> 0 AND hit_label THEN 2::DOUBLE * sd_label * z_label ELSE 0 END AS label"
    z_label = normal(roll("row_id", ("tr0", "tr1")), roll("row_id", ("ta0", "ta1")))
    base = base.add_all(
        [
            ("rep", f"SELECT * FROM {values(rows)} AS t(repeat, {seeds})"),
            ("told", f"SELECT f.*, rep.*, {first('row_id', 'sp', f'ceil({cfg.TEST_SIZE}::DOUBLE * {size})')} AS is_test FROM feats f, rep"),
            ("clean", "SELECT * FROM told WHERE NOT is_test"),
            ("cells", f"SELECT repeat, row_id, j, {first(cell, 'mc', hit)} AS lost, {first(cell, 'fn', hit)} AS noisy FROM clean, range({width}) AS t(j)"),
            ("flags", f"SELECT repeat, row_id, {flags} FROM cells GROUP BY ALL"),
            *copied,
            ("again", again),
            (
                "marked",
                f"SELECT c.repeat, c.row_id, {', '.join(FEATURES)}, label, {', '.join(f'lost_{c}, noisy_{c}, {e} AS z_{c}' for c, e in z.items())},"
                f" {first('c.row_id', 'tn', hit).replace('PARTITION BY repeat', 'PARTITION BY c.repeat')} AS hit_label, {z_label.replace('row_id', 'c.row_id')} AS z_label,"
                " coalesce(k, 0) AS extra FROM clean c JOIN flags USING (repeat, row_id) LEFT JOIN again a ON a.repeat = c.repeat AND a.row_id = c.row_id"
                .replace("PARTITION BY repeat)", "PARTITION BY c.repeat)"),
            ),
            ("sds", f"SELECT repeat, {deviations}, {guarded('stddev_pop(label)')} AS sd_label FROM marked GROUP BY repeat"),
            (
                "train",
                f"SELECT repeat, mask, {damaged_cells}, {shifted}, unnest(range(CASE WHEN mask & 8 <> 0 THEN 1 + extra ELSE 1 END))"
                " FROM marked JOIN sds USING (repeat), range(16) AS m(mask)",
            ),
            ("test", f"SELECT repeat, mask, {', '.join(FEATURES)}, label FROM told, range(16) AS m(mask) WHERE is_test"),
        ]
    )
    return ridge(base, "train", "test", ("repeat", "mask"))


MODEL_CHANNELS = ("missing_cells", "feature_noise", "target_noise", "duplicate_rows")


def model_sql() -> dict[str, str]:
    missing = PRICES.add_all(
        [
            cell_hits("missing_cells"),
            (
                "lost",
                "SELECT row_id, "
                + ", ".join(f"CASE WHEN coalesce(hit_{c}, false) THEN NULL ELSE {c} END AS {c}" for c in FEATURES)
                + f", label FROM feats LEFT JOIN ({wide('missing_cells')}) USING (row_id)",
            ),
        ]
    )

    def noise(base: Ctes, source: str, out: str) -> Ctes:
        steps = []
        for i, c in enumerate(FEATURES):
            key = f"row_id * {len(FEATURES)} + {i}"
            z = normal(roll(key, model_seeds("feature_noise", "radius")), roll(key, model_seeds("feature_noise", "angle")))
            sd = f"(SELECT CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END FROM {source})"
            steps.append(f"CASE WHEN coalesce(hit_{c}, false) THEN {c} + 3::DOUBLE * {sd} * {z} ELSE {c} END AS {c}")
        return base.add_all(
            [
                cell_hits("feature_noise"),
                (
                    out,
                    f"SELECT row_id, {', '.join(steps)}, label FROM {source}"
                    f" LEFT JOIN ({wide('feature_noise')}) USING (row_id)",
                ),
            ]
        )

    z = normal(roll("row_id", model_seeds("target_noise", "radius")), roll("row_id", model_seeds("target_noise", "angle")))
    shift = (
        f"CASE WHEN row_id IN ({row_hits('target_noise', 'feats')}) THEN label + 2::DOUBLE"
        f" * (SELECT stddev_pop(label) FROM feats) * {z} ELSE label END"
    )
    dup = copies("again", [(0, cfg.MODEL_SEVERITY, ("features", cfg.MODEL_MASTER, 0, "duplicate_rows"))], "feats", "row_id")
    composed = noise(missing, "lost", "noisy").add_all(dup)
    composed = composed.add("shifted", f"SELECT * EXCLUDE (label), {shift} AS label FROM noisy")
    flip_pick = f"(({roll('row_id', model_seeds('target_noise', 'class'))} * (len(classes) - 1)) >> 31) + 1"
    emb = Ctes(("feats", "SELECT vec_id AS row_id, label FROM embeddings"))
    docs_columns = {
        "n_chars": "n_chars::DOUBLE",
        "n_words": "len(words)::DOUBLE",
        "word_length": "list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / greatest(len(words), 1)",
        "digit_share": "length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(text), 1)",
        "upper_share": "length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / greatest(length(text), 1)",
    }
    docs = (
        "SELECT doc_id AS row_id, "
        + ", ".join(f"{r(e)} AS {c}" for c, e in docs_columns.items())
        + r", quality AS label FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words"
        " FROM documents) JOIN labels USING (doc_id)"
    )
    seeds = values([(i, *seed_words("split", cfg.MODEL_MASTER, i)) for i in range(cfg.SPLITS)])
    split = (
        "SELECT repeat::INTEGER AS repeat, row_id, place <= take AS is_test FROM (SELECT repeat, row_id, {take} AS take,"
        " row_number() OVER (PARTITION BY repeat{by} ORDER BY " + roll("row_id", ("one", "two")) + ", row_id) AS place"
        " FROM {table}, " + seeds + " AS t(repeat, one, two))"
    )
    strata = Ctes(
        ("feats", "SELECT doc_id AS row_id, quality AS label FROM documents JOIN labels USING (doc_id)"),
        (
            "sizes",
            "SELECT label, n, want, want * n::DOUBLE / total AS exact FROM (SELECT label, count(*) AS n, sum(count(*)) OVER ()"
            f" AS total, ceil({cfg.TEST_SIZE}::DOUBLE * (sum(count(*)) OVER ())) AS want FROM feats GROUP BY 1)",
        ),
        (
            "quotas",
            "SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)"
            " <= want - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM sizes",
        ),
        ("joined", "SELECT * FROM feats JOIN quotas USING (label)"),
    )
    scaled = []
    for c in FEATURES:
        filled = f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM lost))"
        scaled.append(f"{r(f'({filled} - avg({filled}) OVER ()) / stddev_pop({filled}) OVER ()')} AS {c}")
    spread = "(SELECT quantile_cont(label, 0.75) - quantile_cont(label, 0.25) FROM feats)"
    whole = ", ".join(f"{r(c)} AS {c}" for c in (*FEATURES, "label"))
    four = ", ".join(f"{r(c, 4)} AS {c}" for c in (*FEATURES, "label"))
    fitted = composed.add_all(
        [
            (
                "train",
                f"SELECT 0 AS one, {', '.join(FEATURES)}, label FROM (SELECT * FROM shifted UNION ALL SELECT s.* FROM"
                " (SELECT row_id, unnest(range(k)) FROM again) JOIN shifted s USING (row_id))",
            ),
            ("test", f"SELECT 0 AS one, {', '.join(FEATURES)}, label FROM feats"),
        ]
    )
    names = sorted((n, 1 << i) for i, n in enumerate(MODEL_CHANNELS))
    listed = "list_filter([" + ", ".join(f"CASE WHEN mask & {b} <> 0 THEN '{n}' END" for n, b in names) + "], lambda x: x IS NOT NULL)"
    key = f"CASE WHEN mask = 0 THEN 'EMPTY' ELSE array_to_string({listed}, '|') END"
    surfaced = ridge_surface(PRICES, cfg.MODEL_MASTER, cfg.REPEATS)
    # the file's rows are numbered by all their columns
    numbered = Ctes(
        *[
            (n if n != "feats" else "lines_of_file", b) for n, b in PRICES.parts
        ],
        (
            "feats",
            f"SELECT row_number() OVER (ORDER BY {', '.join(FEATURES)}, label) - 1 AS row_id, {', '.join(FEATURES)}, label FROM lines_of_file",
        ),
    )
    doses = [(f"dose_{i}", ridge_surface(PRICES, cfg.MODEL_MASTER, cfg.DOSE_REPEATS, x).select("SELECT repeat, mask, loss FROM ridge_loss")) for i, x in enumerate(cfg.DOSES)]
    dosed = Ctes(*doses, ("risks", " UNION ALL ".join(f"SELECT {x}::DOUBLE AS severity, * FROM dose_{i}" for i, x in enumerate(cfg.DOSES))))
    dosed = boot(
        accounts(dosed, "risks", "severity", MODEL_CHANNELS), "risks", list(range(cfg.DOSE_REPEATS)), "severity", MODEL_CHANNELS
    )
    audited = ridge_surface(numbered, cfg.MODEL_MASTER, cfg.REPEATS).add("risks", "SELECT repeat, mask, loss FROM ridge_loss")
    audited = boot(accounts(audited, "risks", channels=MODEL_CHANNELS), "risks", list(range(cfg.REPEATS)), channels=MODEL_CHANNELS)
    return {
        "ml_fit_ridge": ridge(fitted, "train", "test", ("one",)).select(f"SELECT 'ridge' AS model, {r('loss')} AS loss FROM ridge_loss"),
        "ml_ridge_surface": surfaced.select(
            f"SELECT repeat::INTEGER AS repeat, mask::BIGINT AS mask, {key} AS coalition_key, bit_count(mask)::INTEGER AS coalition_size,"
            f" {r('loss')} AS loss, n AS train_rows FROM ridge_loss"
        ),
        "audit_report": estimates(audited),
        "model_dose_response": estimates(dosed, "severity"),
        "price_features": PRICES.select(f"SELECT row_id, {whole} FROM feats"),
        "document_features": docs,
        "ml_missing_cells": missing.select(f"SELECT row_id, {whole} FROM lost"),
        "ml_own_defect": PRICES.add_all(
            [
                cell_hits("missing_cells"),
                (
                    "cut",
                    f"SELECT row_id, {', '.join(f'CASE WHEN row_id IN ({row_hits('cut_cells', 'feats')}) THEN floor({c}) ELSE {c} END AS {c}' for c in FEATURES)}, label FROM feats",
                ),
            ]
        ).select(
            f"SELECT row_id, {', '.join(f'CASE WHEN coalesce(hit_{c}, false) THEN NULL ELSE {r(c)} END AS {c}' for c in FEATURES)}, {r('label')} AS label"
            f" FROM cut LEFT JOIN ({wide('missing_cells')}) USING (row_id)"
        ),
        "ml_feature_noise": noise(PRICES, "feats", "noisy").select(f"SELECT row_id, {four} FROM noisy"),
        "ml_target_noise": PRICES.select(f"SELECT row_id, {r(shift, 4)} AS label FROM feats"),
        "ml_target_flip": emb.select(
            f"SELECT row_id, CASE WHEN row_id IN ({row_hits('target_noise', 'feats')})"
            f" THEN list_filter(classes, lambda x: x <> label)[{flip_pick}] ELSE label END::INTEGER AS label"
            " FROM feats, (SELECT list_sort(list(DISTINCT label)) AS classes FROM feats)"
        ),
        "ml_duplicate_rows": PRICES.add_all(dup).select(
            f"SELECT row_id, {r('quantity')} AS quantity, {r('label')} AS label FROM feats UNION ALL"
            f" SELECT row_id, {r('quantity')}, {r('label')} FROM (SELECT row_id, unnest(range(k)) FROM again) JOIN feats USING (row_id)"
        ),
        "ml_all_composed": composed.select(
            f"SELECT row_id, {four} FROM (SELECT * FROM shifted UNION ALL SELECT s.* FROM"
            " (SELECT row_id, unnest(range(k)) FROM again) JOIN shifted s USING (row_id))"
        ),
        "split_random": PRICES.select(
            split.format(table="feats", by="", take=f"ceil({cfg.TEST_SIZE}::DOUBLE * (SELECT count(*) FROM feats))")
        ),
        "split_stratified": strata.select(split.format(table="joined", by=", label", take="take")),
        "impute_scale": missing.select(f"SELECT row_id, {', '.join(scaled)} FROM lost"),
        "loss_classification": f"SELECT {r('avg((quality <> toxic)::INTEGER)')} AS loss FROM labels",
        "loss_regression": PRICES.select(
            f"SELECT {r(f'avg(least(abs(quantity * retail_price - label) / {spread}, 1))')} AS loss FROM feats"
        ),
    }


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (source_sql, workload_sql, choice_sql, channel_sql, surface_sql, attribution_sql, sampling_sql, wide_sql, model_sql):
        out.update(part())
    return out
