"""SQL for the registered graph queries, written apart from their DataFrame
form: where that shares work between rows, this spells it out."""

from __future__ import annotations

from veilgraph.functions import scalars
from veilgraph.plans.catalogue import EPSILON, SEED
from veilgraph.sources.results import METRICS


def u(purpose: str, *keys: str) -> str:
    """A keyed uniform draw."""
    text = " || '|' || ".join([f"'{SEED}|{purpose}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def bits(purpose: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{SEED}|{purpose}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def lap(scale: str, draw: str) -> str:
    return f"(CASE WHEN {draw} < 0.5 THEN ({scale})::DOUBLE * ln(2 * {draw}) ELSE -({scale})::DOUBLE * ln(2 * (1 - {draw})) END)"


def gumbel(draw: str) -> str:
    return f"(-ln(-ln({draw})))"


_PAIRS = "l AS (SELECT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"
_PART = f"""{_PAIRS},
g AS (SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM l WHERE u <> v),
v AS (SELECT p_partkey AS vid FROM part),
p AS (SELECT p_partkey AS vid, substr(p_brand, 7)::BIGINT AS com FROM part),
a AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
dg AS (SELECT vid, count(a.src) AS deg FROM v LEFT JOIN a ON a.src = v.vid GROUP BY vid),
ec AS (SELECT src, dst, x.com AS cu, y.com AS cv FROM g JOIN p x ON x.vid = src JOIN p y ON y.vid = dst),
ind AS (SELECT least(cu, cv) AS ci, greatest(cu, cv) AS cj, count(*) AS w FROM ec GROUP BY 1, 2),
intra AS (SELECT p.com, p.vid, count(e.x) AS deg FROM p LEFT JOIN (SELECT src AS x FROM ec WHERE cu = cv UNION ALL SELECT dst FROM ec WHERE cu = cv) e ON e.x = p.vid GROUP BY 1, 2)"""
def part(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_PART}\n{rest}" if rest.lstrip().startswith("SELECT") else f"WITH {'RECURSIVE ' if recursive else ''}{_PART},\n{rest}"


def norm_sub(name: str, rows: str, keys: str, value: str) -> str:
    """CTE name: the rows with column fit, every shift tried on every row."""
    return f"""{name}_t AS (SELECT *, trunc({value})::BIGINT AS x_, {keys} AS k_ FROM {rows}),
{name}_s AS (SELECT k_, min(x_) AS low, sum(x_) AS total FROM {name}_t GROUP BY k_),
{name}_i AS (SELECT k_, total, unnest(range(0, -low)) AS i FROM {name}_s WHERE low < 0),
{name}_g AS (SELECT s.k_, i, abs(sum(greatest(x_ - i, 0)) - any_value(total)) AS gap FROM {name}_i s JOIN {name}_t t ON s.k_ = t.k_ GROUP BY s.k_, i),
{name}_b AS (SELECT k_, first(i ORDER BY gap, i) AS shift FROM {name}_g GROUP BY k_),
{name} AS (SELECT t.*, CASE WHEN shift IS NULL THEN x_ ELSE greatest(x_ - shift, 0) END AS fit FROM {name}_t t LEFT JOIN {name}_b b ON t.k_ = b.k_)"""


def edge_vector(epsilon: float) -> str:
    return f"""cm AS (SELECT DISTINCT com FROM p),
ev0 AS (SELECT a.com AS ci, b.com AS cj, coalesce(w, 0) AS raw FROM cm a JOIN cm b ON a.com < b.com LEFT JOIN ind ON ci = a.com AND cj = b.com),
ev1 AS (SELECT *, raw + {lap(str(1 / epsilon), u('edge-vector', 'ci', 'cj'))} AS noisy FROM ev0),
{norm_sub('ev2', 'ev1', '0', 'noisy')},
ev AS (SELECT ci, cj, raw, noisy, fit AS ev FROM ev2)"""


def degree_sequence(epsilon: float) -> str:
    return f"""ds1 AS (SELECT *, deg + {lap(str(2 / epsilon), u('degree-sequence', 'vid'))} AS noisy FROM intra),
{norm_sub('ds2', 'ds1', 'com', 'noisy')},
ds AS (SELECT com, vid, noisy, greatest(0, least(fit, count(*) OVER (PARTITION BY com) - 1))::BIGINT AS target FROM ds2)"""


_RELEASE = f"{edge_vector(EPSILON)},\n{degree_sequence(EPSILON)}"
_CHUNG_LU_PAIRS = f"""cl AS (
  SELECT x.vid AS src, y.vid AS dst FROM ds x JOIN ds y ON x.com = y.com AND x.vid < y.vid
  JOIN (SELECT com, sum(target) AS s FROM ds GROUP BY com) t ON t.com = x.com
  WHERE s > 0 AND {u('chung-lu', 'x.vid', 'y.vid')} * s < x.target * y.target)"""


def chung_lu(rows: str = "ds", weight: str = "target") -> str:
    """CTE cl: geometric steps over the numbered candidates of each two blocks
    of equal degree."""
    return f"""cl_r AS MATERIALIZED (SELECT com, vid, {weight}::BIGINT AS d, row_number() OVER (PARTITION BY com, {weight} ORDER BY vid) - 1 AS place FROM {rows} WHERE {weight} > 0),
cl_b AS (SELECT com, d, count(*) AS n FROM cl_r GROUP BY 1, 2),
cl_s AS (SELECT com, sum(d)::DOUBLE AS s FROM cl_r GROUP BY 1),
cl_p AS (SELECT x.com, x.d AS da, y.d AS db, y.n AS nb, CASE WHEN x.d = y.d THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS many, least(1::DOUBLE, (x.d * y.d)::DOUBLE / s) AS p
  FROM cl_b x JOIN cl_b y ON x.com = y.com AND x.d <= y.d JOIN cl_s ON cl_s.com = x.com),
cl_q AS (SELECT *, unnest(range(0, (many - 1) // size + 1)) AS run FROM (SELECT *, ceil(65536::DOUBLE / p)::BIGINT AS size FROM cl_p WHERE many > 0)),
cl_t AS (SELECT *, least(size, many - run * size) AS here FROM cl_q),
cl_k AS (SELECT *, unnest(range(1, least(here, (ceil(here * p + 8 * sqrt(here * p)) + 12)::BIGINT) + 1)) AS k FROM cl_t),
cl_u AS (SELECT *, {u('chung-lu', 'com', 'da', 'db', 'run', 'k')} AS u, CASE WHEN p < 0.0001::DOUBLE THEN -(p + p * p / 2 + p * p * p / 3) ELSE ln(1 - p) END AS scale FROM cl_k WHERE p < 1 UNION ALL SELECT *, 0.5::DOUBLE, 1::DOUBLE FROM cl_k WHERE p >= 1),
cl_a AS (SELECT *, (sum(CASE WHEN p >= 1 THEN 1 ELSE floor(ln(u) / scale)::BIGINT + 1 END) OVER (PARTITION BY com, da, db, run ORDER BY k) - 1)::BIGINT AS inside FROM cl_u),
cl_h AS (SELECT com, da, db, nb, inside + run * size AS spot FROM cl_a WHERE inside < here),
cl_g AS (SELECT *, floor((1 + sqrt((1 + 8 * spot)::DOUBLE)) / 2)::BIGINT AS near FROM cl_h),
cl_f AS (SELECT *, CASE WHEN near * (near - 1) // 2 > spot THEN near - 1 WHEN (near + 1) * near // 2 <= spot THEN near + 1 ELSE near END AS low FROM cl_g),
cl_e AS (SELECT com, da, db, CASE WHEN da = db THEN low ELSE spot // nb END AS i, CASE WHEN da = db THEN spot - low * (low - 1) // 2 ELSE spot % nb END AS j FROM cl_f),
cl AS MATERIALIZED (SELECT least(x.vid, y.vid) AS src, greatest(x.vid, y.vid) AS dst FROM cl_e e JOIN cl_r x ON x.com = e.com AND x.d = da AND x.place = i JOIN cl_r y ON y.com = e.com AND y.d = db AND y.place = j)"""


_CHUNG_LU = chung_lu()
_INTER = f"""flat AS (SELECT com, vid, row_number() OVER (PARTITION BY com ORDER BY vid) - 1 AS slot, count(*) OVER (PARTITION BY com) AS n FROM ds),
asked AS (SELECT ci, cj, unnest(range(1, ev + 1)) AS k FROM ev WHERE ev > 0),
un AS (
  SELECT DISTINCT least(x.vid, y.vid) AS src, greatest(x.vid, y.vid) AS dst FROM asked
  JOIN flat x ON x.com = ci AND x.slot = floor({u('inter-u', 'ci', 'cj', 'k')} * x.n)
  JOIN flat y ON y.com = cj AND y.slot = floor({u('inter-v', 'ci', 'cj', 'k')} * y.n) WHERE x.vid <> y.vid)"""
def slots(rows: str = "ds", weight: str = "greatest(target, 1)") -> str:
    return f"""cum AS MATERIALIZED (SELECT com, vid, {weight} AS w, sum({weight}) OVER (PARTITION BY com ORDER BY vid) AS upto, sum({weight}) OVER (PARTITION BY com) AS n FROM {rows}),
sz AS (SELECT com, count(*) AS n FROM ds GROUP BY com)"""


_SLOTS = slots()


def targets(n_intra: str, n_inter: str) -> str:
    return f"""tg AS (
  SELECT ci, cj, 0 AS part, ci AS ca, ci AS cb, floor(floor({n_intra}) / 2)::BIGINT AS want FROM ev WHERE ev > 0
  UNION ALL SELECT ci, cj, 1, cj, cj, (floor({n_intra}) - floor(floor({n_intra}) / 2))::BIGINT FROM ev WHERE ev > 0
  UNION ALL SELECT ci, cj, 2, ci, cj, floor({n_inter})::BIGINT FROM ev WHERE ev > 0)"""


def samples(purpose: str, draws: str) -> str:
    key = ("t.ci", "t.cj", "t.part", "t.k")
    return f"""dr AS (SELECT t.*, unnest(range(1, ({draws})::BIGINT + 1)) AS k FROM (SELECT tg.*, x.n AS na, y.n AS nb FROM tg JOIN sz x ON x.com = ca JOIN sz y ON y.com = cb WHERE want > 0) t),
sm AS (
  SELECT t.ci, t.cj, t.part, t.want, t.k, least(x.vid, y.vid) AS src, greatest(x.vid, y.vid) AS dst FROM dr t
  JOIN cum x ON x.com = ca AND floor({u(purpose + '-u', *key)} * x.n) >= x.upto - x.w AND floor({u(purpose + '-u', *key)} * x.n) < x.upto
  JOIN cum y ON y.com = cb AND floor({u(purpose + '-v', *key)} * y.n) >= y.upto - y.w AND floor({u(purpose + '-v', *key)} * y.n) < y.upto
  WHERE x.vid <> y.vid)"""


_INTRA_DRAWS = "least(floor(1.5::DOUBLE * least(want, na * (na - 1) // 2)) + 10, na * (na - 1))"
_INTER_DRAWS = "least(floor(1.3::DOUBLE * want) + 5, na * nb)"
_FREE_DRAWS = f"CASE WHEN part < 2 THEN {_INTRA_DRAWS} ELSE {_INTER_DRAWS} END"


def accept(rounds: int = 12) -> str:
    """CTE ac: what targets hold once no sample is lost any more."""
    out = ["""fr0 AS MATERIALIZED (SELECT * EXCLUDE (turn), (ci * 1000000 + cj) * 10 + part AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst, ci, cj, part ORDER BY k) AS turn FROM sm WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.src = sm.src AND cl.dst = sm.dst)) WHERE turn = 1)"""]
    for k in range(rounds):
        out.append(f"ft{k} AS (SELECT *, row_number() OVER (PARTITION BY ci, cj, part ORDER BY k) <= want AS held FROM fr{k})")
        out.append(f"fr{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (held, holder) FROM (SELECT *, min(CASE WHEN held THEN place END) OVER (PARTITION BY src, dst) AS holder FROM ft{k}) WHERE holder IS NULL OR place <= holder)")
    out.append(f"ac AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY ci, cj, part ORDER BY k) <= want AS held FROM fr{rounds}) WHERE held)")
    return ",\n".join(out)


def free(n_intra: str, n_inter: str, purpose: str = "free", base: str = _CHUNG_LU, weights: str = _SLOTS, draws: str = _FREE_DRAWS) -> str:
    return ",\n".join([base, weights, targets(n_intra, n_inter), samples(purpose, draws), accept()])


def _ways(edges: str) -> str:
    return f"(SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges})"


def repair(edges: str, degrees: str = "ds", tolerance: float = 0.3, rounds: int = 4) -> str:
    """CTE fixed: trimming, then adding, in rounds."""
    slack = f"greatest(floor(want * {tolerance}::DOUBLE), 1)"
    out = [
        f"rt AS MATERIALIZED (SELECT com, vid, want, (want + {slack})::BIGINT AS most, (want - {slack})::BIGINT AS least FROM (SELECT com, vid, greatest(target, 1)::BIGINT AS want FROM {degrees}))",
        f"e0 AS MATERIALIZED ({edges})",
    ]
    for r in range(rounds):
        bits_ = bits(f"trim-{r}", "a", "b")
        out += [
            f"ta{r} AS (SELECT e.src, x.com = y.com AS near, x.most, least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b FROM {_ways(f'e{r}')} e JOIN rt x ON x.vid = e.src JOIN rt y ON y.vid = e.dst)",
            f"tn{r} AS (SELECT *, greatest(count(*) OVER (PARTITION BY src) - most, 0) AS surplus, row_number() OVER (PARTITION BY src ORDER BY near, {bits_}, a, b) AS t FROM ta{r})",
            f"tx{r} AS MATERIALIZED (SELECT a, b FROM tn{r} WHERE surplus > 0 GROUP BY a, b HAVING {'bool_or' if r == rounds - 1 else 'bool_and'}(t <= surplus))",
            f"e{r + 1} AS MATERIALIZED (SELECT src, dst FROM e{r} WHERE NOT EXISTS (SELECT 1 FROM tx{r} WHERE a = src AND b = dst))",
        ]
    out.append(f"f0 AS MATERIALIZED (SELECT src, dst FROM e{rounds})")
    for r in range(rounds):
        draw, bits_ = u(f"add-{r}", "q.vid", "q.k"), bits(f"new-{r}", "a", "b")
        out += [
            f"fd{r} AS MATERIALIZED (SELECT rt.*, greatest(least - coalesce(n, 0), 0) AS lack, greatest(10 * (want - coalesce(n, 0)), 1) AS w FROM rt LEFT JOIN (SELECT src, count(*) AS n FROM {_ways(f'f{r}')} GROUP BY 1) ON src = vid)",
            f"fc{r} AS MATERIALIZED (SELECT com, vid, w, sum(w) OVER (PARTITION BY com ORDER BY vid) AS upto, sum(w) OVER (PARTITION BY com) AS n FROM fd{r})",
            f"fk{r} AS (SELECT com, vid, lack, unnest(range(1, (floor(1.5::DOUBLE * lack) + 10)::BIGINT + 1)) AS k FROM fd{r} WHERE lack > 0)",
            f"fp{r} AS (SELECT q.vid, lack, k, c.vid AS other, least(q.vid, c.vid) AS src, greatest(q.vid, c.vid) AS dst FROM fk{r} q JOIN fc{r} c ON c.com = q.com AND floor({draw} * c.n) >= c.upto - c.w AND floor({draw} * c.n) < c.upto WHERE q.vid <> c.vid)",
            f"fo{r} AS (SELECT * FROM fp{r} x WHERE NOT EXISTS (SELECT 1 FROM f{r} y WHERE y.src = x.src AND y.dst = x.dst) QUALIFY row_number() OVER (PARTITION BY vid, other ORDER BY k) = 1)",
            f"fq{r} AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT * FROM fo{r} QUALIFY row_number() OVER (PARTITION BY vid ORDER BY k) <= lack))",
            f"fw{r} AS (SELECT a, b, lack = 0 OR row_number() OVER (PARTITION BY src ORDER BY {bits_}, a, b) <= lack AS within FROM (SELECT e.src, least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b, lack FROM {_ways(f'fq{r}')} e JOIN fd{r} ON vid = e.src))",
            f"f{r + 1} AS MATERIALIZED (SELECT src, dst FROM f{r} UNION ALL SELECT a, b FROM fw{r} GROUP BY a, b HAVING bool_and(within))",
        ]
    out.append(f"fixed AS (SELECT src, dst FROM f{rounds})")
    return ",\n".join(out)


_MADE = "SELECT src, dst FROM cl UNION ALL SELECT src, dst FROM ac"
#: v2's budgets of each vertex.
_BUDGETS = """ro AS (SELECT com, sum(ev)::BIGINT AS out FROM (SELECT ci AS com, ev FROM ev UNION ALL SELECT cj, ev FROM ev) GROUP BY 1),
b0 AS (SELECT com, vid, target, coalesce(out, 0) AS out, greatest(target, 1)::DOUBLE / sum(greatest(target, 1)) OVER (PARTITION BY com) AS w, sum(target) OVER (PARTITION BY com) > 0 AS has,
  count(*) OVER (PARTITION BY com) AS size, row_number() OVER (PARTITION BY com ORDER BY target DESC, vid) AS turn FROM ds LEFT JOIN ro USING (com)),
b1 AS (SELECT *, CASE WHEN has THEN floor(floor(out * 0.85::DOUBLE) / 2) ELSE 0 END AS total FROM b0),
b2 AS (SELECT *, round_even(w * total, 0) AS share FROM b1),
b3 AS (SELECT *, total - sum(share) OVER (PARTITION BY com) AS gap FROM b2),
b4 AS (SELECT *, (share + CASE WHEN abs(gap) >= turn THEN sign(gap) * (floor((abs(gap) - turn) / size) + 1) ELSE 0 END)::BIGINT AS convert FROM b3),
bu AS MATERIALIZED (SELECT *, (CASE WHEN has THEN least(round_even(w * out * (1 - 0.85::DOUBLE), 0), target) ELSE 0 END)::BIGINT AS inter, greatest(0, least(target + convert, size - 1)) AS inner_ FROM b4),
wa AS MATERIALIZED (SELECT com, vid, target + convert + inter AS target FROM bu)"""
_LEFT = f"""lf AS MATERIALIZED (SELECT com, vid, target - coalesce(n, 0) AS rest FROM ds LEFT JOIN (SELECT src, count(*) AS n FROM {_ways('cl')} GROUP BY 1) ON src = vid)"""


def louvain(nodes: str, links: str, levels: int = 3, rounds: int = 6) -> str:
    """CTE lv (vid, com): set-based rounds over nodes (vid) and links (src,
    dst, w), src <= dst."""
    out = [f"k0 AS MATERIALIZED (SELECT src, dst, w::DOUBLE AS w FROM {links})", "lm AS (SELECT sum(w) AS m FROM k0)", f"m0 AS MATERIALIZED (SELECT vid, vid AS com FROM {nodes})"]
    for v in range(levels):
        out += [
            f"st{v} AS MATERIALIZED (SELECT vid, sum(w) AS s FROM (SELECT src AS vid, w FROM k{v} UNION ALL SELECT dst, w FROM k{v}) GROUP BY 1)",
            f"ar{v} AS MATERIALIZED (SELECT src, dst, w FROM k{v} WHERE src <> dst UNION ALL SELECT dst, src, w FROM k{v} WHERE src <> dst)",
            f"lb{v}_0 AS MATERIALIZED (SELECT n.vid, n.vid AS com, coalesce(s, 0) AS s FROM (SELECT DISTINCT com AS vid FROM m{v}) n LEFT JOIN st{v} ON st{v}.vid = n.vid)",
        ]
        for r in range(rounds):
            now = f"lb{v}_{r}"
            out += [
                f"in{v}_{r} AS (SELECT vid, c, sum(w) AS w FROM (SELECT a.src AS vid, l.com AS c, a.w FROM ar{v} a JOIN {now} l ON l.vid = a.dst UNION ALL SELECT vid, com, 0 FROM {now}) GROUP BY 1, 2)",
                f"gn{v}_{r} AS (SELECT i.vid, i.c, l.com, i.w - (mass - CASE WHEN i.c = l.com THEN l.s ELSE 0 END) * l.s / (2 * m) AS gain FROM in{v}_{r} i JOIN {now} l ON l.vid = i.vid JOIN (SELECT com AS mc, sum(s) AS mass FROM {now} GROUP BY 1) ON mc = i.c, lm)",
                f"bs{v}_{r} AS (SELECT vid, first(c ORDER BY gain DESC, c) AS c, max(gain) AS gain, max(CASE WHEN c = com THEN gain END) AS now FROM gn{v}_{r} GROUP BY 1)",
                f"lb{v}_{r + 1} AS MATERIALIZED (SELECT l.vid, CASE WHEN {bits('louvain-deal', 'l.vid')} % 2 = {(r + rounds * v) % 2} AND gain > now + 1e-12::DOUBLE THEN c ELSE com END AS com, s FROM {now} l JOIN bs{v}_{r} b ON b.vid = l.vid)",
            ]
        last = f"lb{v}_{rounds}"
        out += [
            f"m{v + 1} AS MATERIALIZED (SELECT x.vid, y.com FROM m{v} x JOIN {last} y ON y.vid = x.com)",
            f"k{v + 1} AS MATERIALIZED (SELECT least(x.com, y.com) AS src, greatest(x.com, y.com) AS dst, sum(w) AS w FROM k{v} k JOIN {last} x ON x.vid = k.src JOIN {last} y ON y.vid = k.dst GROUP BY 1, 2)",
        ]
    out.append(f"lv AS MATERIALIZED (SELECT vid, dense_rank() OVER (ORDER BY least) - 1 AS com FROM (SELECT vid, min(vid) OVER (PARTITION BY com) AS least FROM m{levels}))")
    return ",\n".join(out)


def super_graph(groups: str, epsilon: float) -> str:
    """CTE sg (ci, cj, w) from groups (vid, com)."""
    return f"""gc AS (SELECT DISTINCT com FROM {groups}),
gi AS (SELECT least(x.com, y.com) AS i, greatest(x.com, y.com) AS j, count(*) AS w FROM g JOIN {groups} x ON x.vid = src JOIN {groups} y ON y.vid = dst GROUP BY 1, 2),
sg0 AS (SELECT x.com AS ci, y.com AS cj, CASE WHEN x.com = y.com THEN 2 ELSE 1 END * coalesce(w, 0) AS w FROM gc x JOIN gc y ON x.com <= y.com LEFT JOIN gi ON i = x.com AND j = y.com),
sg1 AS (SELECT *, w + CASE WHEN ci = cj THEN {lap(repr(2 / epsilon), u('super-graph', 'ci', 'cj'))} ELSE {lap(repr(1 / epsilon), u('super-graph', 'ci', 'cj'))} END AS noisy FROM sg0),
{norm_sub('sg2', 'sg1', 'ci = cj', 'noisy')},
sg AS MATERIALIZED (SELECT ci, cj, fit AS w FROM sg2)"""


def grouped(groups: str, epsilon: float) -> str:
    """CTE st (vid, com): the groups' Louvain communities."""
    return f"""gp AS MATERIALIZED ({groups}),
{super_graph('gp', epsilon)},
sn AS (SELECT DISTINCT com AS vid FROM gp), sk AS (SELECT ci AS src, cj AS dst, w FROM sg WHERE w > 0),
{louvain('sn', 'sk')},
st AS MATERIALIZED (SELECT gp.vid, lv.com FROM gp JOIN lv ON lv.vid = gp.com)"""


def em_pass(start: str, epsilon: float, batches: int, chosen: list[int]) -> str:
    """CTE em (vid, com): keyed batches re-draw their communities, each from
    the state that the one before left."""
    out = [f"q0 AS MATERIALIZED (SELECT vid, dense_rank() OVER (ORDER BY com) - 1 AS com FROM {start})"]
    for n, b in enumerate(chosen):
        out += [
            f"ek{n} AS (SELECT max(com) + 1 AS k FROM q{n})",
            f"es{n} AS (SELECT vid, com, {epsilon / 4!r}::DOUBLE * w + {gumbel(u(f'em-batch-{b}', 'vid', 'com'))} AS score FROM (SELECT a.src AS vid, com, count(*) AS w FROM a JOIN q{n} q ON q.vid = a.dst GROUP BY 1, 2))",
            f"eb{n} AS (SELECT vid, first(com ORDER BY score DESC, com) AS com, max(score) AS score, list(com) AS near FROM es{n} GROUP BY vid)",
            f"el{n} AS (SELECT q.vid, q.com, b.com AS bc, score, [c FOR c IN range(0, k) IF NOT list_contains(coalesce(near, []), c)] AS rest FROM q{n} q LEFT JOIN eb{n} b ON b.vid = q.vid, ek{n})",
            f"""em{n} AS MATERIALIZED (SELECT vid, CASE WHEN {bits('em-deal', 'vid')} % {batches} <> {b} THEN com
  WHEN len(rest) > 0 AND (bc IS NULL OR ln(len(rest)) + {gumbel(u(f'em-rest-{b}', 'vid'))} > score) THEN rest[1 + floor({u(f'em-which-{b}', 'vid')} * len(rest))::BIGINT] ELSE bc END AS com FROM el{n})""",
            f"q{n + 1} AS MATERIALIZED (SELECT vid, dense_rank() OVER (ORDER BY com) - 1 AS com FROM em{n})",
        ]
    return ",\n".join(out)


def publication(epsilon: float, size: int) -> str:
    """CTE fixed: the edges of a published graph, from groups to repair."""
    third = 1 / 3 * epsilon
    last = (1 - 1 / 3 - 1 / 3) * epsilon
    groups = f"SELECT vid, (row_number() OVER (ORDER BY {u('groups', 'vid')}, vid) - 1) // {size} AS com FROM v"
    over = """xc AS (SELECT src, dst, x.com AS cu, y.com AS cv FROM g JOIN q4 x ON x.vid = src JOIN q4 y ON y.vid = dst),
xi AS (SELECT least(cu, cv) AS ci, greatest(cu, cv) AS cj, count(*) AS w FROM xc GROUP BY 1, 2),
xd AS (SELECT q4.com, q4.vid, count(e.x) AS deg FROM q4 LEFT JOIN (SELECT src AS x FROM xc WHERE cu = cv UNION ALL SELECT dst FROM xc WHERE cu = cv) e ON e.x = q4.vid GROUP BY 1, 2)"""
    released = f"{edge_vector(last)},\n{degree_sequence(last)}".replace("FROM p)", "FROM q4)").replace("LEFT JOIN ind ", "LEFT JOIN xi ").replace("FROM intra)", "FROM xd)")
    return ",\n".join([grouped(groups, third), em_pass("st", third, 4, [0, 1, 2, 3]), over, released, free("ev * 0.4::DOUBLE", "ev * 0.2::DOUBLE"), repair(_MADE)])


def discounted(edges: str, k: int, p: float) -> str:
    """CTEs b1, b2, ... (vid, score): seeds by degree discount over edges
    (src, dst, weight)."""
    out = [f"wa AS MATERIALIZED (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges})", "s0 AS MATERIALIZED (SELECT src AS vid, sum(weight)::DOUBLE AS d, 0::DOUBLE AS t, sum(weight)::DOUBLE AS score, 0 AS stamp FROM wa GROUP BY src)"]
    for r in range(1, k + 1):
        out.append(f"b{r} AS MATERIALIZED (SELECT vid, score FROM s{r - 1} ORDER BY score DESC, stamp, vid LIMIT 1)")
        out.append(f"s{r} AS MATERIALIZED (SELECT s.vid, d, t + coalesce(w, 0) AS t, CASE WHEN w IS NULL THEN s.score ELSE d - 2 * (t + w) - (d - (t + w)) * (t + w) * {p}::DOUBLE END AS score, CASE WHEN w IS NULL THEN stamp ELSE {r} END AS stamp FROM s{r - 1} s LEFT JOIN (SELECT dst AS n, weight AS w FROM wa JOIN b{r} ON src = vid) ON n = s.vid WHERE s.vid NOT IN (SELECT vid FROM b{r}))")
    return ",\n".join(out)


def steps(k: int) -> str:
    out = ["x0 AS MATERIALIZED (SELECT vid, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v)"]
    for i in range(k):
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT vid, any_value(x) + coalesce(sum(y), 0) AS x FROM (SELECT b.vid, b.x, c.x AS y FROM x{i} b LEFT JOIN a ON a.dst = b.vid LEFT JOIN x{i} c ON c.vid = a.src) GROUP BY vid)")
    return ",\n".join([*out, f"evc AS (SELECT vid, round(x / sqrt((SELECT sum(x * x) FROM x{k})), 6) AS evc FROM x{k})"])


_RANKINGS = f"""rk AS (SELECT vid, deg::DOUBLE AS deg, round(deg + {lap('5.0', u('degree', 'vid'))}, 6) AS noisy FROM dg),
kk AS (SELECT (floor(0.05::DOUBLE * count(*)))::BIGINT AS k FROM rk),
ra AS (SELECT * FROM (SELECT vid, deg AS x, row_number() OVER (ORDER BY deg DESC, vid) AS r FROM rk), kk WHERE r <= k),
rb AS (SELECT * FROM (SELECT vid, noisy AS x, row_number() OVER (ORDER BY noisy DESC, vid) AS r FROM rk), kk WHERE r <= k)"""
_RUNS = "runs AS (SELECT id, 0.5::DOUBLE * (1 + id % 7) AS eps, (id // 7) % 5 AS exper, CASE WHEN id < 35 THEN 'a' ELSE 'b' END AS method, " + ", ".join(f"round({u(m, 'id')}, 4) AS {m}" for m in METRICS) + " FROM range(70) t(id))"
_GRID = f"""gr AS (SELECT seq, (seq // 8 % 8 + 1) / 10::DOUBLE AS e1_r, (seq % 8 + 1) / 10::DOUBLE AS e2_r, round({u('grid', 'seq')}, 4) AS nmi FROM range(128) t(seq)),
la AS (SELECT * FROM gr WHERE e1_r + e2_r < 0.95 QUALIFY row_number() OVER (PARTITION BY e1_r, e2_r ORDER BY seq DESC) = 1)"""
_WEIGHTED = f"{_PAIRS},\nwe AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, count(*) AS weight FROM l WHERE u <> v GROUP BY 1, 2)"


def cascade(seeds: str) -> str:
    return f"""WITH RECURSIVE {_WEIGHTED},
lv AS (SELECT t.trial, src, dst FROM we, range(50) t(trial) WHERE {u('cascade', 't.trial', 'src', 'dst')} < 1 - pow(1 - 0.02::DOUBLE, weight)),
la AS MATERIALIZED (SELECT trial, src, dst FROM lv UNION ALL SELECT trial, dst, src FROM lv),
rc AS (SELECT t.trial, s.vid FROM range(50) t(trial), ({seeds}) s UNION SELECT la.trial, la.dst FROM rc JOIN la ON la.trial = rc.trial AND la.src = rc.vid),
cs AS (SELECT trial::INTEGER AS trial, count(*) AS size FROM rc GROUP BY 1)"""


#: The split's formulas, spelled out: shares of epsilon, clipped, scaled to
#: sum 1; then what the first leaves, dealt anew (fixed values).
_BUDGET = """WITH c AS (SELECT n::INTEGER AS n, deg::DOUBLE AS deg, eps::DOUBLE AS eps FROM (VALUES (1000), (20000)) x(n), (VALUES (5), (20), (80)) y(deg), (VALUES (0.5), (1.0), (2.0), (3.5)) z(eps)),
s AS (SELECT *, greatest(0.05::DOUBLE, least(4::DOUBLE / (deg * eps), 0.2::DOUBLE)) AS r3, 0.368::DOUBLE + 0.363::DOUBLE / eps - 0.033::DOUBLE * ln(n) AS q1 FROM c),
t AS (SELECT *, greatest(0.05::DOUBLE, least(q1, 0.5::DOUBLE)) AS r1, greatest(0.15::DOUBLE, least(1 - q1 - r3, 0.85::DOUBLE)) AS r2 FROM s),
w AS (SELECT *, r1 / (r1 + r2 + r3) AS e1, r2 / (r1 + r2 + r3) AS e2, r3 / (r1 + r2 + r3) AS e3 FROM t),
k AS (SELECT *, deg * ((n / 30::DOUBLE) / n) / (2::DOUBLE / (e3 * eps)) AS snr FROM w),
f AS (SELECT *, greatest(0.05::DOUBLE, least(1.891::DOUBLE - 0.528::DOUBLE / eps - 0.087::DOUBLE * ln(n) - 0.001::DOUBLE * 30 - 0.234::DOUBLE * snr, 0.85::DOUBLE)) AS f2 FROM k)
SELECT n, deg, eps, round(e1, 6) AS e1, round(e2, 6) AS e2, round(e3, 6) AS e3, round((1 - e1) * f2 / (f2 + 0.1::DOUBLE), 6) AS c2, round((1 - e1) - (1 - e1) * f2 / (f2 + 0.1::DOUBLE), 6) AS c3 FROM f"""


def _group_of(order: str, rows: str, size: int | str, direction: str) -> str:
    return f"SELECT vid, (row_number() OVER (ORDER BY {order} {direction}, vid) - 1) // {size} AS com FROM {rows}"


#: Clipped at a bound that follows from the number of vertices.
_NEAR_SCORES = f"""bo AS (SELECT floor(sqrt(count(*)::DOUBLE) * (1 + ln(greatest(1::DOUBLE, {EPSILON}::DOUBLE)))) + 1 AS c FROM v),
nd AS (SELECT vid, deg + {lap(repr(2 / (0.3 * EPSILON / 2)), u('degree', 'vid'))} AS d FROM dg),
sc AS MATERIALIZED (SELECT nd.vid, any_value(nd.d) + 0.5::DOUBLE * (coalesce(sum(greatest(0, least(o.d, c))), 0) + any_value({lap('1', u('neighbour-sum', 'nd.vid'))} * (2 * c / (0.3::DOUBLE * {EPSILON}::DOUBLE / 2)))) AS score
  FROM bo, nd LEFT JOIN a ON a.src = nd.vid LEFT JOIN nd o ON o.vid = a.dst GROUP BY nd.vid)"""
_A = "exp(-1 / 2.0::DOUBLE)"
_TRI = "t AS (SELECT count(*) AS triangles FROM g x JOIN g y ON y.src = x.dst JOIN g z ON z.src = x.src AND z.dst = y.dst), w AS (SELECT sum(deg * (deg - 1) // 2)::BIGINT AS wedges FROM dg)"

ORACLES: dict[str, str] = {
    "q_vertices_dense": f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY x) - 1 AS vid, x AS orig_id FROM (SELECT u AS x FROM l UNION SELECT v FROM l)",
    "q_edges_canonical": part("n AS (SELECT row_number() OVER (ORDER BY x) - 1 AS vid, x FROM (SELECT u AS x FROM l UNION SELECT v FROM l)) SELECT b.vid AS src, c.vid AS dst FROM g JOIN n b ON b.x = src JOIN n c ON c.x = dst"),
    "q_edge_multiplicity": f"WITH {_PAIRS} SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS weight FROM l GROUP BY 1, 2",
    "q_graph_counts": part("SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM g) AS edges"),
    "q_line_counts": f"WITH {_PAIRS} SELECT (SELECT count(*) FROM (SELECT u FROM l UNION SELECT v FROM l)) AS nodes, (SELECT count(*) FROM l) AS edges",
    "q_edge_lines": part("SELECT src AS u, dst AS v, 2::BIGINT AS weight FROM g"),
    "q_csr_decode": part("SELECT src, dst FROM a"),
    "q_degree": part("SELECT vid, deg FROM dg"),
    "q_degree_hist": part("SELECT d AS deg, count(vid) AS n FROM (SELECT unnest(range(0, (SELECT max(deg) + 1 FROM dg))) AS d) LEFT JOIN dg ON deg = d GROUP BY d"),
    "q_degree_topk": part("SELECT vid, deg, row_number() OVER (ORDER BY deg DESC, vid)::INTEGER AS rank FROM dg QUALIFY rank <= 20"),
    "q_comm_members": part("SELECT com, count(*) AS size, string_agg(vid::VARCHAR, ',' ORDER BY vid) AS members FROM p GROUP BY com"),
    "q_comm_size": part("SELECT com, count(*) AS size FROM p GROUP BY com"),
    "q_comm_edge_matrix": part("cm AS (SELECT DISTINCT com FROM p) SELECT a.com AS ci, b.com AS cj, coalesce(CASE WHEN a.com = b.com THEN 2 * w ELSE w END, 0)::BIGINT AS w FROM cm a JOIN cm b ON a.com <= b.com LEFT JOIN ind ON ci = a.com AND cj = b.com"),
    "q_induced_graph": part("SELECT ci, cj, w FROM ind"),
    "q_neighbor_comm_weights": part("SELECT a.src AS vid, com, count(*) AS w FROM a JOIN p ON p.vid = a.dst GROUP BY 1, 2"),
    "q_all_comm_weights": part("cm AS (SELECT DISTINCT com FROM p), nw AS (SELECT a.src AS x, com AS c, count(*) AS w FROM a JOIN p ON p.vid = a.dst GROUP BY 1, 2) SELECT vid, com, coalesce(w, 0) AS w FROM v CROSS JOIN cm LEFT JOIN nw ON x = vid AND c = com"),
    "q_modularity": part("SELECT round(sum(coalesce(w, 0) / m - pow(dsum / (2 * m), 2)), 6) AS modularity FROM (SELECT com, sum(deg)::DOUBLE AS dsum FROM dg JOIN p USING (vid) GROUP BY com) LEFT JOIN ind ON ci = com AND cj = com, (SELECT count(*)::DOUBLE AS m FROM g)"),
    "q_modularity_res": part("""s AS (SELECT p_partkey AS vid, p_size AS com FROM part), i AS (SELECT x.com AS c, count(*) AS w FROM g JOIN s x ON x.vid = src JOIN s y ON y.vid = dst WHERE x.com = y.com GROUP BY 1)
SELECT round(sum(0.5::DOUBLE * coalesce(w, 0) / m - pow(dsum / (2 * m), 2)), 6) AS modularity FROM (SELECT com, sum(deg)::DOUBLE AS dsum FROM dg JOIN s USING (vid) GROUP BY com) LEFT JOIN i ON c = com, (SELECT count(*)::DOUBLE AS m FROM g)"""),
    "q_intra_degree": part("SELECT com, vid, deg FROM intra"),
    "q_status": part("SELECT com, count(*) AS size, sum(deg)::BIGINT AS degree, any_value(coalesce(w, 0)) AS internal, (SELECT count(*) FROM g) AS total FROM dg JOIN p USING (vid) LEFT JOIN ind ON ci = com AND cj = com GROUP BY com"),
    "q_renumber": part("SELECT vid, dense_rank() OVER (ORDER BY com) - 1 AS com FROM p"),
    "q_dendrogram_level": part("SELECT vid, (com // 10) % 2 AS com FROM p"),
    "q_triangles": part(f"{_TRI} SELECT triangles, wedges FROM t, w"),
    "q_transitivity": part(f"{_TRI} SELECT round(3 * triangles / wedges::DOUBLE, 6) AS transitivity FROM t, w"),
    "q_common_neighbors": part("SELECT x.src AS u, y.src AS v, count(*) AS n FROM a x JOIN a y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2"),
    "q_non_neighbors": part("SELECT x.com, x.vid AS u, y.vid AS v FROM p x JOIN p y ON x.com = y.com AND x.vid < y.vid WHERE NOT EXISTS (SELECT 1 FROM g WHERE src = x.vid AND dst = y.vid)"),
    "q_components": part(",\n".join(["c0 AS MATERIALIZED (SELECT vid, vid AS c FROM v)", *(f"c{k + 1} AS MATERIALIZED (SELECT vid, min(c) AS c FROM (SELECT vid, c FROM c{k} UNION ALL SELECT a.dst, c FROM a JOIN c{k} ON vid = a.src) GROUP BY vid)" for k in range(30))]) + " SELECT vid, c AS component FROM c30"),
    "q_bfs_levels": part("r AS (SELECT vid AS source, vid, 0 AS depth FROM v WHERE vid BETWEEN 1 AND 3 UNION SELECT source, dst, depth + 1 FROM r JOIN a ON src = vid WHERE depth < 30) SELECT source, vid, min(depth) AS depth FROM r GROUP BY 1, 2", True),
    "q_diameter": part(",\n".join(["w0 AS MATERIALIZED (SELECT vid, set_bit(bitstring('0', (SELECT count(*)::INTEGER FROM v)), (row_number() OVER (ORDER BY vid) - 1)::INTEGER, 1) AS s FROM v)", *(f"w{k + 1} AS MATERIALIZED (SELECT vid, bit_or(s) AS s FROM (SELECT vid, s FROM w{k} UNION ALL SELECT a.dst, s FROM a JOIN w{k} ON vid = a.src) GROUP BY vid)" for k in range(30))]) + " SELECT ((SELECT count(DISTINCT n) FROM (" + " UNION ALL ".join(f"SELECT sum(bit_count(s)) AS n FROM w{k}" for k in range(31)) + ")) - 1)::INTEGER AS diameter"),
    "q_evc_10iter": part(f"{steps(10)} SELECT vid, evc FROM evc"),
    "q_evc_topk": part(f"{steps(10)} SELECT vid, evc, row_number() OVER (ORDER BY evc DESC, vid)::INTEGER AS rank FROM evc QUALIFY rank <= floor(0.05::DOUBLE * (SELECT count(*) FROM evc))"),
    "q_deg_kl": part(f"""h AS (SELECT deg, count(*) / (SELECT count(*) FROM dg)::DOUBLE AS p FROM dg GROUP BY deg), k AS (SELECT 10 * deg AS deg, count(*) / (SELECT count(*) FROM intra)::DOUBLE AS q FROM intra GROUP BY 1)
SELECT round(sum(p * ln((p + {scalars.DOUBLE_EPS}::DOUBLE) / (coalesce(q, 0) + {scalars.DOUBLE_EPS}::DOUBLE))), 6) AS kl FROM h LEFT JOIN k USING (deg)"""),
    "q_nmi": """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
x AS (SELECT a, sum(n) AS na FROM c GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY b)
SELECT round(2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN x USING (a) JOIN y USING (b), t) / ((SELECT -sum(na / t * ln(na / t)) FROM x, t) + (SELECT -sum(nb / t * ln(nb / t)) FROM y, t)), 6) AS nmi""",
    "q_overlap_topk": part(f"{_RANKINGS} SELECT round(count(rb.vid) / count(*)::DOUBLE, 6) AS overlap FROM ra LEFT JOIN rb ON ra.vid = rb.vid"),
    "q_mae_rank": part(f"{_RANKINGS} SELECT round(avg(abs(ra.x - rb.x)), 6) AS mae FROM ra JOIN rb ON ra.r = rb.r"),
    "q_mse": part(f"{_RANKINGS} SELECT round(avg(pow(ra.x - rb.x, 2)), 6) AS mse FROM ra JOIN rb ON ra.r = rb.r"),
    "q_rel_err": part("SELECT vid, round(abs((dg.deg - intra.deg) / (dg.deg + 1e-15::DOUBLE)), 6) AS rel_err FROM dg JOIN intra USING (vid)"),
    "q_rank_all": part("SELECT vid, deg, row_number() OVER (ORDER BY deg DESC, vid) - 1 AS rank FROM dg"),
    "q_noise": f"""WITH d AS (SELECT id, {u('noise', 'id')} AS u FROM range(2000) t(id))
SELECT id, round(u, 6) AS u, round({lap('2.0', 'u')}, 6) AS laplace, round({gumbel('u')}, 6) AS gumbel,
  CASE WHEN u <= {_A} / (1 + {_A}) THEN -floor(ln(u * (1 + {_A})) / ln({_A})) ELSE greatest(ceil(ln((1 - u) * (1 + {_A})) / ln({_A})) - 1, 0) END::BIGINT AS geometric FROM d""",
    "q_laplace_degree": part(f"SELECT vid, deg, round(deg + {lap(str(2 / EPSILON), u('degree', 'vid'))}, 6) AS noisy FROM dg"),
    "q_norm_sub": part(f"n0 AS (SELECT vid, round(deg + {lap('20.0', u('degree', 'vid'))}, 6) - 15 AS noisy, com FROM dg JOIN p USING (vid)), {norm_sub('ns', 'n0', 'com', 'noisy')} SELECT com, vid, round(noisy, 6) AS noisy, fit FROM ns"),
    "q_noisy_edge_matrix": part(f"{edge_vector(EPSILON / 20)} SELECT ci, cj, raw, round(noisy, 6) AS noisy, ev FROM ev"),
    "q_noisy_degree_seq": part(f"{degree_sequence(EPSILON)} SELECT com, vid, round(noisy, 6) AS noisy, target FROM ds"),
    "q_random_groups": part(f"SELECT vid, (row_number() OVER (ORDER BY {u('groups', 'vid')}, vid) - 1) // 20 AS com FROM v"),
    "q_init_supergraph": part(f"""gp AS (SELECT vid, (row_number() OVER (ORDER BY {u('groups', 'vid')}, vid) - 1) // 50 AS com FROM v), cm AS (SELECT DISTINCT com FROM gp),
gi AS (SELECT least(x.com, y.com) AS i, greatest(x.com, y.com) AS j, count(*) AS w FROM g JOIN gp x ON x.vid = src JOIN gp y ON y.vid = dst GROUP BY 1, 2),
c0 AS (SELECT x.com AS ci, y.com AS cj, CASE WHEN x.com = y.com THEN 2 ELSE 1 END * coalesce(w, 0) AS w FROM cm x JOIN cm y ON x.com <= y.com LEFT JOIN gi ON i = x.com AND j = y.com),
c1 AS (SELECT *, w + CASE WHEN ci = cj THEN {lap(str(2 / EPSILON), u('super-graph', 'ci', 'cj'))} ELSE {lap(str(1 / EPSILON), u('super-graph', 'ci', 'cj'))} END AS noisy FROM c0),
{norm_sub('c2', 'c1', 'ci = cj', 'noisy')} SELECT ci, cj, fit AS w FROM c2"""),
    "q_init_degree_groups": part(f"SELECT vid, (row_number() OVER (ORDER BY round(deg + {lap(str(2 / (0.3 * EPSILON)), u('degree', 'vid'))}, 6) DESC, vid) - 1) // 44 AS com FROM dg"),
    "q_init_neighbor_groups": part(f"""nd AS (SELECT vid, deg + {lap(str(2 / (0.3 * EPSILON / 2)), u('degree', 'vid'))} AS d FROM dg),
sc AS (SELECT nd.vid, any_value(nd.d) + 0.5::DOUBLE * (coalesce(sum(greatest(0, least(o.d, 60))), 0) + any_value({lap(str(2 * 60 / (0.3 * EPSILON / 2)), u('neighbour-sum', 'nd.vid'))})) AS score FROM nd LEFT JOIN a ON a.src = nd.vid LEFT JOIN nd o ON o.vid = a.dst GROUP BY nd.vid)
SELECT vid, (row_number() OVER (ORDER BY round(score, 6) DESC, vid) - 1) // 20 AS com FROM sc"""),
    "q_em_batch": part(f"{em_pass('p', 4 * EPSILON, 3, [1])} SELECT vid, com FROM em0"),
    "q_adjust_communities": part(f"{em_pass('p', EPSILON, 4, [0, 1, 2, 3])} SELECT vid, com FROM q4"),
    "q_louvain": part(f"l1 AS (SELECT src, dst, 1 AS w FROM g),\n{louvain('v', 'l1')} SELECT vid, com FROM lv"),
    "q_init_random": part(f"{grouped(_group_of(u('groups', 'vid'), 'v', 10, ''), EPSILON)} SELECT vid, com FROM st"),
    "q_init_degree": part(f"{grouped(_group_of('deg + ' + lap(repr(2 / (0.3 * EPSILON)), u('degree', 'vid')), 'dg', '(SELECT floor(sqrt(count(*)::DOUBLE))::BIGINT FROM v)', 'DESC'), (1 - 0.3) * EPSILON)} SELECT vid, com FROM st"),
    "q_init_neighbor": part(f"{_NEAR_SCORES},\n{grouped(_group_of('score', 'sc', 10, 'DESC'), (1 - 0.3) * EPSILON)} SELECT vid, com FROM st"),
    "q_chung_lu": part(f"{degree_sequence(EPSILON)},\n{_CHUNG_LU} SELECT src, dst FROM cl"),
    "q_chung_lu_pairs": part(f"{degree_sequence(EPSILON)},\n{_CHUNG_LU_PAIRS} SELECT src, dst FROM cl"),
    "q_inter_uniform": part(f"{_RELEASE},\n{_INTER} SELECT src, dst FROM un"),
    "q_synth_original": part(f"{_RELEASE},\n{_CHUNG_LU},\n{_INTER} SELECT src, dst FROM cl UNION SELECT src, dst FROM un"),
    "q_weighted_sample": part(f"SELECT com, vid FROM dg JOIN p USING (vid) WHERE deg > 0 QUALIFY row_number() OVER (PARTITION BY com ORDER BY -ln({u('sample', 'com', 'vid')}) / deg, vid) <= 5"),
    "q_weighted_pick": part(f"{degree_sequence(EPSILON)},\n{_SLOTS}, rq AS (SELECT DISTINCT com, unnest(range(1, 11))::INTEGER AS k FROM ds) SELECT rq.com, k, vid FROM rq JOIN cum ON cum.com = rq.com AND floor({u('pick', 'rq.com', 'k')} * n) >= upto - w AND floor({u('pick', 'rq.com', 'k')} * n) < upto"),
    "q_collision_free_accept": part(f"{_RELEASE},\n{free('ev * 0.4::DOUBLE', 'ev * 0.2::DOUBLE')} SELECT src, dst FROM ac"),
    "q_synth_v3": part(f"{_RELEASE},\n{free('ev * 0.4::DOUBLE', 'ev * 0.2::DOUBLE')},\n{repair(_MADE)} SELECT src, dst FROM fixed"),
    "q_synth_v3_convert": part(f"{_RELEASE},\n{free('ev * 0.4::DOUBLE', 'ev - floor(ev * 0.4::DOUBLE)')},\n{repair(_MADE)} SELECT src, dst FROM fixed"),
    "q_synth_v2": part(f"{_RELEASE},\n{_BUDGETS},\n{free('0', 'ev * (1 - 0.85::DOUBLE) + 1e-9::DOUBLE', 'v2', chung_lu('bu', 'inner_'), slots('bu', 'greatest(10 * inter, 1)'), _INTER_DRAWS)},\n{repair(_MADE, 'wa', 0.2)} SELECT src, dst FROM fixed"),
    "q_synth_v4": part(f"{_RELEASE},\n{free('ev * 0.9::DOUBLE', 'ev - floor(ev * 0.9::DOUBLE)', 'v4', _CHUNG_LU + ', ' + _LEFT, slots('lf', 'greatest(10 * rest, 1)'))},\n{repair(_MADE)} SELECT src, dst FROM fixed"),
    "q_repair_rounds": part(f"{degree_sequence(EPSILON)},\n{repair('SELECT src, dst FROM g')} SELECT src, dst FROM fixed"),
    "q_synth_convert_oversample": part(",\n".join([_RELEASE, _CHUNG_LU, _SLOTS, targets("ev * 0.9::DOUBLE", "ev - floor(ev * 0.9::DOUBLE)"), samples("convert", "CASE WHEN part < 2 THEN floor(least(floor(want * 1.2::DOUBLE), na * (na - 1) / 2)) ELSE want END")]) + " SELECT src, dst FROM cl UNION SELECT src, dst FROM sm"),
    "q_publish": part(f"{publication(2.0, 10)} SELECT src, dst FROM fixed"),
    "q_degree_discount": f"WITH {_WEIGHTED},\n{discounted('we', 20, 0.01)} " + " UNION ALL ".join(f"SELECT {r}::INTEGER AS rank, vid, round(score, 6) AS score FROM b{r}" for r in range(1, 21)),
    "q_influence": f"WITH RECURSIVE {_PART},\n{_WEIGHTED.removeprefix(_PAIRS + ',')},\n{degree_sequence(EPSILON)},\n{_CHUNG_LU}, made AS (SELECT src, dst, 2 AS weight FROM cl),\n{discounted('made', 5, 0.02)},\n"
    + "live AS (" + f"SELECT t.trial, src, dst FROM we, range(20) t(trial) WHERE {u('cascade', 't.trial', 'src', 'dst')} < 1 - pow(1 - 0.02::DOUBLE, weight)),\n"
    + "both_ AS MATERIALIZED (SELECT trial, src, dst FROM live UNION ALL SELECT trial, dst, src FROM live),\n"
    + "rc AS (SELECT t.trial, s.vid FROM range(20) t(trial), (" + " UNION ALL ".join(f"SELECT vid FROM b{r}" for r in range(1, 6)) + ") s UNION SELECT l.trial, l.dst FROM rc JOIN both_ l ON l.trial = rc.trial AND l.src = rc.vid)\n"
    + "SELECT round_even(avg(size), 0)::BIGINT AS spread FROM (SELECT trial, count(*) AS size FROM rc GROUP BY 1)",
    "q_prune_inter": part(f"{edge_vector(EPSILON)}, pr AS (SELECT src, dst, least(cu, cv) AS i, greatest(cu, cv) AS j, row_number() OVER (PARTITION BY least(cu, cv), greatest(cu, cv) ORDER BY {bits('prune', 'src', 'dst')}, src, dst) AS t FROM ec) SELECT src, dst FROM pr LEFT JOIN ev ON ci = i AND cj = j WHERE i = j OR t <= coalesce(ev // 2, 0)"),
    "q_cross_cleanup": part(f"""od AS (SELECT src, dst, least(cu, cv) AS i, greatest(cu, cv) AS j, cu <> cv AND x.deg * y.deg <= 2 * (SELECT count(*) FROM g) AS odd FROM ec JOIN dg x ON x.vid = src JOIN dg y ON y.vid = dst),
nm AS (SELECT *, count(*) OVER (PARTITION BY i, j) AS cnt, row_number() OVER (PARTITION BY i, j, odd ORDER BY {bits('cross', 'src', 'dst')}, src, dst) AS t FROM od) SELECT src, dst FROM nm WHERE NOT (odd AND t <= cnt - greatest(1, cnt // 2))"""),
    "q_ic_spread": f"{cascade('SELECT unnest(range(1, 6)) AS vid')} SELECT trial, size FROM cs",
    "q_spread_mean": f"{cascade('SELECT unnest(range(1, 4)) AS vid')} SELECT round_even(avg(size), 0)::BIGINT AS spread FROM cs",
    "q_budget_auto": _BUDGET,
    "q_budget_grid": "SELECT round(x / 10::DOUBLE, 6) AS e1_r, round(y / 10::DOUBLE, 6) AS e2_r, round(1 - x / 10::DOUBLE - y / 10::DOUBLE, 6) AS e3_r FROM range(1, 9) a(x), range(1, 9) b(y) WHERE 1 - x / 10::DOUBLE - y / 10::DOUBLE > 0.01",
    "q_run_means": f"WITH {_RUNS} SELECT method, eps, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM runs GROUP BY 1, 2",
    "q_summary": f"WITH {_RUNS}, m AS (SELECT method, eps, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM runs GROUP BY 1, 2) SELECT method, {', '.join(f'round(avg({m}), 6) AS avg_{m}' for m in METRICS)} FROM m GROUP BY 1",
    "q_dedupe_keep_last": f"WITH {_GRID} SELECT seq, e1_r, e2_r, nmi FROM la",
    "q_pivot": f"WITH {_GRID} SELECT e1_r, {', '.join(f'max(nmi) FILTER (round(e2_r * 10) = {k}) AS c_{k}' for k in range(1, 9))} FROM la GROUP BY e1_r",
    "q_log_parse": "SELECT * FROM (VALUES ('one', 2.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.41::DOUBLE, 0.21::DOUBLE, 0.101::DOUBLE, 0.55::DOUBLE, 0.2::DOUBLE, 0.11::DOUBLE, 0.3::DOUBLE), ('two', 3.5, 0.3, 0.4, 0.5, NULL, NULL, NULL, NULL, NULL, NULL), ('three', 3.0, 0.3, 0.4, 0.6, NULL, NULL, NULL, NULL, NULL, NULL)) t(dataset, epsilon, e1_r, e2_r, nmi, evc_overlap, \"evc_MAE\", deg_kl, diam_rel, cc_rel, mod_rel)",
    "q_compound_interest": "SELECT c_custkey, round(c_acctbal * pow(1.03::DOUBLE, 5), 6) AS value FROM customer",
}
