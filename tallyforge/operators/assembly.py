"""Register and check legs: cleaning, de-duplication, matching and trimming. `ord` is the order of rows in a statement."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank, cents, check_number, check_number_of
from ..functions.predicates import looks_like_deposit
from .pieces import LARGE
from .ranks import at_ranks, medians
from .rounds import in_turn
from .sequence import by_size, plain_unions, settled, walked

# Limits of plausible checks, of sparse registers and of trimming.
CHECK_CAP, LEAST_FENCE, SPARSE, TRIM_SLACK = 10_000.0, 500.0, 3, 100.0
LEGS = ["statement_id"]
#: Rows of one ord in a statement at most.
TURNS = 1024


def exclusive_quartile(sorted_values: Column, i: int) -> Column:
    """The i-th of three cut points of a sorted array, of which n values leave n + 1 gaps: for short lists in a cell."""
    n = F.size(sorted_values)
    j = F.least(F.greatest(F.floor(i * (n + 1) / 4).cast("int"), F.lit(1)), n - 1)
    delta = i * (n + 1) - j * 4
    return (F.element_at(sorted_values, j) * (4 - delta) + F.element_at(sorted_values, j + 1) * delta) / 4


def drop_outliers(checks: DataFrame, by: list[str] = LEGS) -> DataFrame:
    """Without null and zero amounts, those over the cap, and unnumbered ones above the upper fence of four or more.

    Quartiles are cut points of n values in n + 1 gaps, of values at exact ranks.
    """
    size = F.abs("amount")
    kept = checks.filter(F.col("amount").isNotNull() & (F.col("amount") != 0) & (size <= CHECK_CAP))
    place = lambda n, i: F.least(F.greatest(F.floor(i * (n + 1) / 4), F.lit(1)), n - 1)
    q = at_ranks(kept, by, size, lambda n: {"__a": place(n, 1), "__b": place(n, 1) + 1, "__c": place(n, 3), "__d": place(n, 3) + 1})

    def cut(i: int, low: str, high: str) -> Column:
        delta = i * (F.col("n") + 1) - place(F.col("n"), i) * 4
        return (F.col(low) * (4 - delta) + F.col(high) * delta) / 4

    low, high = cut(1, "__a", "__b"), cut(3, "__c", "__d")
    fences = q.select(*by, F.when(F.col("n") >= 4, high + F.greatest(3 * (high - low), F.lit(LEAST_FENCE))).alias("__fence"))
    inside = F.col("__fence").isNull() | (size <= F.col("__fence")) | (check_number(F.col("check_no")) != "")
    return kept.join(fences, by).filter(inside).drop("__fence")


def median_pick(checks: DataFrame, by: list[str] = LEGS) -> DataFrame:
    """Of rows with one check number, the one nearest the leg's median amount, the first of equals; others stay."""
    plain_unions(checks.sparkSession)
    middle = medians(checks.filter("amount <> 0"), by, F.abs("amount"), "__median")
    numbered = checks.withColumn("__no", check_number(F.col("check_no")))
    gap = F.abs(F.abs("amount") - F.coalesce("__median", F.lit(0.0)))
    first = F.row_number().over(Window.partitionBy(*by, "__no").orderBy("__gap", "ord"))
    picked = numbered.filter("__no <> ''").join(middle, by, "left").withColumn("__gap", gap).withColumn("__first", first).filter("__first = 1")
    return picked.select(checks.columns).unionByName(numbered.filter("__no = ''").select(checks.columns))


def keep_first(rows: DataFrame, keys: list[Column], order: str = "ord", unless_blank: bool = False, by: list[str] = LEGS) -> DataFrame:
    """The first row of each key; with unless_blank, rows whose keys are all empty stay."""
    named = {f"__k{i}": F.coalesce(k.cast("string"), F.lit("")) for i, k in enumerate(keys)}
    first = F.row_number().over(Window.partitionBy(*by, *named).orderBy(order))
    keyed = rows.withColumns(named).withColumn("__first", first)
    test = F.col("__first") == 1
    if unless_blank:
        test = test | (F.concat(*named) == "")
    return keyed.filter(test).drop(*named, "__first")


def dedupe_transactions(rows: DataFrame) -> DataFrame:
    return keep_first(rows, [F.col("date"), F.substring("description", 1, 80), F.col("amount"), F.col("check_no")])


def dedupe_checks(rows: DataFrame) -> DataFrame:
    payee = F.substring(F.lower(F.trim(F.coalesce(F.nullif(F.col("payee"), F.lit("")), "description"))), 1, 40)
    amount = F.when(F.coalesce("amount", F.lit(0.0)) != 0, cents(F.col("amount")))
    return keep_first(rows, [check_number(F.col("check_no")), payee, amount], unless_blank=True)


def dedupe_check_dicts(checks: DataFrame) -> DataFrame:
    """The first of checks of one number, payee in any case, and amount to the cent; checks without any of them all stay."""
    return keep_first(checks, [blank(F.col("check_no")), F.lower(blank(F.col("pay_to"))), F.round(F.col("amount") * 100).cast("long")], unless_blank=True)


def assembly_dedupe(rows: DataFrame) -> DataFrame:
    """Of rows with `source` register or check_image_crop: one row a check number and amount; no unnumbered crop row
    that repeats a register debit within a cent; one unnumbered crop row an amount and payee (or description)."""
    plain_unions(rows.sparkSession)
    number, crop = check_number(F.col("check_no")), F.col("source") == "check_image_crop"
    numbered = keep_first(rows.filter(number != ""), [number, cents(F.col("amount")) * F.signum("amount")])
    rest = rows.filter(number == "")
    debits = rows.filter((F.col("source") == "register") & (F.col("amount") < 0))
    near = debits.select(*LEGS, F.explode(F.sequence(cents(F.col("amount")) - 1, cents(F.col("amount")) + 1)).alias("__c")).distinct()
    crops = rest.filter(crop).withColumn("__c", cents(F.col("amount"))).join(near, [*LEGS, "__c"], "left_anti")
    zero = crops.filter("__c = 0").drop("__c")
    name = F.substring(F.lower(F.coalesce(F.nullif(blank(F.col("payee")), F.lit("")), blank(F.col("description")))), 1, 40)
    crops = keep_first(crops.filter("__c > 0"), [F.col("__c"), name]).drop("__c")
    return numbered.unionByName(rest.filter(~crop)).unionByName(crops).unionByName(zero)


def is_incomplete(n_register: Column, n_checks: Column) -> Column:
    return (n_register < SPARSE) | ((n_checks > 0) & (n_register < n_checks))


def gate(register: DataFrame, checks: DataFrame) -> DataFrame:
    """n_register, n_checks and incomplete of every statement on either side."""
    count = lambda df, name: df.groupBy(*LEGS).agg(F.count("*").alias(name))
    both = count(register, "n_register").join(count(checks, "n_checks"), LEGS, "full").na.fill(0)
    return both.withColumn("incomplete", is_incomplete(F.col("n_register"), F.col("n_checks")))


def covered(register: DataFrame, checks: DataFrame) -> DataFrame:
    """Pairs of check and register rows: by equal check number, or by amounts within a cent of a register debit.

    Amounts meet as whole cents, of which the check offers three, so that both joins are on equal keys.
    """
    r = register.select(*LEGS, F.col("ord").alias("register_ord"), check_number(F.col("check_no")).alias("__no"), F.col("amount").alias("__a"))
    c = checks.select(*LEGS, F.col("ord").alias("check_ord"), check_number(F.col("check_no")).alias("__no"), F.col("amount").alias("__a"))
    numbers = c.filter("__no <> ''").join(r.filter("__no <> ''"), [*LEGS, "__no"]).select(*LEGS, "check_ord", "register_ord", F.lit("check_number").alias("reason"))
    spread = c.withColumn("__c", F.explode(F.sequence(cents(F.col("__a")) - 1, cents(F.col("__a")) + 1))).select(*LEGS, "check_ord", "__c")
    debits = r.filter("__a < 0").select(*LEGS, "register_ord", cents(F.col("__a")).alias("__c"))
    sums = spread.join(debits, [*LEGS, "__c"]).select(*LEGS, "check_ord", "register_ord", F.lit("amount").alias("reason"))
    first = F.row_number().over(Window.partitionBy(*LEGS, "check_ord", "register_ord").orderBy(F.desc("reason")))
    return numbers.union(sums).withColumn("__n", first).filter("__n = 1").drop("__n")


def best_per_crop(checks: DataFrame) -> DataFrame:
    """One check of each crop_file: with a plausible amount, then a number, then nearest the median of plausible amounts.

    The first by ord of equals. Checks without a crop all stay.
    """
    plain_unions(checks.sparkSession)
    size, crop = F.abs(F.coalesce("amount", F.lit(0.0))), blank(F.col("crop_file"))
    plausible = (size > 0) & (size <= CHECK_CAP)
    middle = checks.select(*LEGS).distinct().join(medians(checks.filter(plausible), LEGS, size, "__m"), LEGS, "left").na.fill({"__m": 0.0})
    rank = F.when(~plausible, F.struct(F.lit(2).alias("k"), F.lit(0.0).alias("gap"))).otherwise(F.struct((blank(F.col("check_no")) == "").cast("int").alias("k"), F.abs(size - F.col("__m")).alias("gap")))
    first = F.row_number().over(Window.partitionBy(*LEGS, "__crop").orderBy("__rank", "ord"))
    marked = checks.join(middle, LEGS).withColumn("__crop", crop).withColumn("__rank", rank)
    lone = marked.filter("__crop = ''")
    picked = marked.filter("__crop <> ''").withColumn("__n", first).filter("__n = 1").drop("__n")
    return picked.unionByName(lone).select(checks.columns)


def supplemental(register: DataFrame, checks: DataFrame) -> DataFrame:
    """statement_id, ord, decision (supplemental, check_number, amount) and register_ord of each check, in order.

    A check takes the first register row of its number or amount; rows of an amount serve as many checks as the
    register has debits of it, and always name the first such row. Statements of LARGE rows and more are decided in rounds
    (rounds.in_turn), which give the same. Of the others, a task walks through many: a statement's register comes before its
    checks and leaves the first row of each number and amount, so each check is decided by four looks.
    """

    def decide(rows: Iterator[tuple]) -> Iterator[tuple]:
        for statement, group in groupby(rows, key=itemgetter(0)):
            numbers, sizes, left = {}, {}, Counter()
            for _, is_check, ord_, number, size, debit in group:
                if not is_check:
                    if number:
                        numbers.setdefault(number, ord_)
                    if debit:
                        sizes.setdefault(size, ord_)
                        left[size] += 1
                    continue
                found = [(sizes[c], 1, c) for c in (size - 1, size, size + 1) if left[c] > 0]
                if number in numbers:
                    found.append((numbers[number], 0, None))
                at, by_amount, c = min(found, default=(None, 0, None))
                if by_amount:
                    left[c] -= 1
                yield statement, ord_, "supplemental" if at is None else "amount" if by_amount else "check_number", at

    def side(df: DataFrame, is_check: bool) -> DataFrame:
        number = check_number(F.col("check_no")) if is_check else check_number_of(F.col("check_no"), F.col("description"))
        amount = F.coalesce("amount", F.lit(0.0))
        return df.select(*LEGS, F.lit(int(is_check)).alias("is_check"), F.col("ord").cast("long").alias("ord"), number.alias("number"), cents(amount).alias("size"), (amount < 0).alias("debit"))

    both = side(register, False).unionByName(side(checks, True))
    small, large = by_size(both, LARGE)
    found = walked(small, LEGS, ["is_check", "ord"], decide, "statement_id string, ord long, decision string, register_ord long")
    return found if large is None else found.unionByName(_supplemental_in_rounds(large.filter("is_check = 0"), large.filter("is_check = 1"))[0])


def _turns(rows: DataFrame, *ties: str) -> DataFrame:
    """rows with `turn`: their order in a statement, in which rows of one ord follow one another."""
    nth = F.row_number().over(Window.partitionBy(*LEGS, "ord").orderBy(*ties)) - 1
    return rows.withColumn("turn", F.col("ord") * TURNS + nth)


def _supplemental_in_rounds(register: DataFrame, checks: DataFrame) -> tuple[DataFrame, int]:
    """supplemental() for statements of any size, and the rounds it took.

    Debits of an amount are a list of slots, of which each check has up to three, by their first row; a number, which serves
    any number of checks, ends them.
    """
    register, checks = settled(register), settled(_turns(checks, "number", "size"))
    numbers = register.filter("number <> ''").groupBy(*LEGS, "number").agg(F.min("ord").alias("number_ord"))
    pools = register.filter("debit").groupBy(*LEGS, "size").agg(F.min("ord").alias("pool_ord"))
    near = checks.join(numbers, [*LEGS, "number"], "left").select(*LEGS, "turn", "number_ord", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    near = near.join(pools, [*LEGS, "size"]).filter(F.col("number_ord").isNull() | (F.col("pool_ord") < F.col("number_ord")))
    keys = near.groupBy(*LEGS, "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pool_ord", "size"))), lambda p: p["size"].cast("string")).alias("keys"))
    slots = _turns(register.filter("debit"), "number").select(*LEGS, F.col("size").cast("string").alias("key"), F.col("turn").alias("slot"), F.col("turn").cast("decimal(38,0)").alias("preference"))
    choice = in_turn(keys, slots)
    taken = choice.chosen.select(*LEGS, "turn", F.col("key").cast(pools.schema["size"].dataType).alias("size")).join(pools, [*LEGS, "size"]).drop("size")
    told = checks.join(numbers, [*LEGS, "number"], "left").join(taken, [*LEGS, "turn"], "left")
    decision = F.when(F.col("pool_ord").isNotNull(), "amount").when(F.col("number_ord").isNotNull(), "check_number").otherwise("supplemental")
    return told.select(*LEGS, "ord", decision.alias("decision"), F.coalesce("pool_ord", "number_ord").alias("register_ord")), choice.rounds


def assemble(register: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, stats): the register and the checks that it lacks, of statements with columns as those of both.

    Checks that look like deposits, implausible amounts and repeats go first. Only statements whose register is then
    too short take checks; register rows that a check covers go where checks were added. stats has a row a statement.
    """
    plain = checks.filter(~looks_like_deposit(blank(F.col("description")), blank(F.col("payee")), *([blank(F.col("review_reason"))] if "review_reason" in checks.columns else [])))
    # Both are read several times below.
    sound = settled(drop_outliers(plain))
    offered = settled(dedupe_checks(median_pick(sound)))
    state = gate(register, offered)
    short = state.filter("incomplete").select(*LEGS)
    decided = supplemental(register.join(short, LEGS, "left_semi"), offered.join(short, LEGS, "left_semi"))
    more = offered.join(decided.filter("decision = 'supplemental'").select(*LEGS, "ord"), [*LEGS, "ord"], "left_semi")
    grown = more.select(*LEGS).distinct()
    covered_rows = decided.filter("register_ord is not null").join(grown, LEGS, "left_semi").select(*LEGS, F.col("register_ord").alias("ord")).distinct()
    kept = register.join(covered_rows, [*LEGS, "ord"], "left_anti")
    count = lambda df, name: df.groupBy(*LEGS).agg(F.count("*").alias(name))
    tally = decided.join(offered.select(*LEGS, "ord", check_number(F.col("check_no")).alias("__no")), [*LEGS, "ord"])
    tally = tally.groupBy(*LEGS).agg(
        F.count_if(F.col("decision") == "supplemental").alias("supplemental"), F.count_if((F.col("decision") == "supplemental") & (F.col("__no") == "")).alias("by_amount"),
        F.count_if(F.col("decision") == "check_number").alias("skipped_by_check_number"), F.count_if(F.col("decision") == "amount").alias("skipped_by_amount"),
    )
    stats = state.withColumn("sparse", F.col("n_register") < SPARSE)
    # A null or zero amount is left out but not counted as rejected.
    valued = plain.filter(F.coalesce("amount", F.lit(0.0)) != 0)
    for df, name in ((checks, "offered"), (plain, "__plain"), (valued, "__valued"), (sound, "__sound"), (covered_rows, "pruned")):
        stats = stats.join(count(df, name), LEGS, "left")
    stats = stats.join(tally, LEGS, "left").na.fill(0)
    stats = stats.withColumn("rejected_deposits", F.col("offered") - F.col("__plain")).withColumn("rejected_outliers", F.col("__valued") - F.col("__sound"))
    return kept.unionByName(more, allowMissingColumns=True), stats.drop("__plain", "__valued", "__sound")


def budget_trim(checks: DataFrame, budgets: DataFrame, cap: int | None = None) -> DataFrame:
    """Checks of statements (with `budget`) that fit it: all within the slack, or of no positive budget; else numbered
    first, nearest the median of amounts first, those that still fit, at most `cap`; all again if that leaves more than
    the slack. The cap never drops rows of a statement within its budget.
    """
    size = F.abs(F.coalesce("amount", F.lit(0.0)))
    known = checks.groupBy(*LEGS).agg(F.sum(size).alias("__total")).join(medians(checks.filter(size > 0), LEGS, size, "__median"), LEGS, "left").na.fill({"__median": 0.0}).join(budgets, LEGS)
    over = known.filter((F.col("budget") > 0) & (F.col("__total") > F.col("budget") + TRIM_SLACK))
    ranked = checks.join(over, LEGS).select(*LEGS, (check_number(F.col("check_no")) == "").alias("bare"), F.abs(size - F.col("__median")).alias("gap"), F.col("ord").cast("long").alias("ord"), size.alias("size"), F.col("budget").cast("double").alias("budget"))

    def take(rows: Iterator[tuple]) -> Iterator[tuple]:
        for statement, group in groupby(rows, key=itemgetter(0)):
            total, n = 0.0, 0
            for _, _, _, ord_, amount, budget in group:
                if (cap is None or n < cap) and total + amount <= budget + TRIM_SLACK:
                    total, n = total + amount, n + 1
                    yield statement, ord_, None
            if total < budget - TRIM_SLACK:
                yield statement, None, total

    taken = walked(ranked, LEGS, ["bare", "gap", "ord"], take, "statement_id string, ord long, left double")
    under = taken.filter("ord is null").select(*LEGS)
    whole = known.select(*LEGS).join(over.select(*LEGS), LEGS, "left_anti").unionByName(under)
    part = checks.join(taken.filter("ord is not null").select(*LEGS, "ord"), [*LEGS, "ord"], "left_semi").join(under, LEGS, "left_anti")
    return checks.join(whole, LEGS, "left_semi").unionByName(part)


def merge_payees(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Blank and uncategorised payees filled from checks: by the very number (the last check of it), else by the first
    unused check within a cent of the amount. A check fills one row. Filled register rows become check_image_crop.

    A check without a name fills nothing, but stands before later ones of its amount. Every row comes out once; rows of one
    ord in a statement are filled alike.
    """
    open_payee = F.lower(blank(F.col("payee"))).isin("", "uncategorized")

    def fill(events: Iterator[tuple]) -> Iterator[tuple]:
        for statement, group in groupby(events, key=itemgetter(0)):
            numbers, sizes, used = {}, defaultdict(list), set()
            for _, is_row, ord_, number, size, name, is_open in group:
                if not is_row:
                    if number:
                        numbers[number] = (ord_, name)
                    if size:
                        sizes[size].append((ord_, name))
                    continue
                if number in numbers:
                    at, payee = numbers[number]
                elif size is None:
                    continue
                else:
                    free = [next((c for c in sizes[k] if c[0] not in used), None) for k in (size - 1, size, size + 1) if k in sizes]
                    at, payee = min((c for c in free if c), default=(None, ""))
                if is_open and payee and at not in used:
                    used.add(at)
                    yield statement, ord_, payee

    events = checks.select(*LEGS, F.lit(0).alias("is_row"), F.col("ord").cast("long").alias("ord"), blank(F.col("check_no")).alias("number"), cents(F.col("amount")).alias("size"), blank(F.col("pay_to")).alias("name"), F.lit(False).alias("open"))
    mine = rows.select(*LEGS, F.lit(1).alias("is_row"), F.col("ord").cast("long").alias("ord"), blank(F.col("check_no")).alias("number"), cents(F.col("amount")).alias("size"), F.lit("").alias("name"), open_payee.alias("open"))
    small, large = by_size(events.unionByName(mine), LARGE)
    given = walked(small, LEGS, ["is_row", "ord"], fill, "statement_id string, ord long, __payee string")
    if large is not None:
        given = given.unionByName(_payees_in_rounds(large.filter("is_row = 0"), large.filter("is_row = 1 and open"))[0])
    given = given.groupBy(*LEGS, "ord").agg(F.min("__payee").alias("__payee"))
    source = F.when(F.col("__payee").isNotNull() & F.lower(blank(F.col("source"))).isin("", "register"), "check_image_crop").otherwise(F.col("source"))
    return rows.join(given, [*LEGS, "ord"], "left").withColumn("source", source).withColumn("payee", F.coalesce("__payee", "payee")).select(rows.columns)


def _payees_in_rounds(checks: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """statement_id, ord and payee of open rows that a check fills, for statements of any size, and the rounds it took.

    A number's list is its last check, if that has a name; an amount's list ends before its first check without one.
    """
    checks, rows = settled(checks), settled(_turns(rows, "number", "size"))
    last = checks.filter("number <> ''").groupBy(*LEGS, "number").agg(F.max_by(F.struct("ord", "name"), F.struct("ord", "name")).alias("c"))
    by_number = last.filter("c.name <> ''").select(*LEGS, F.concat(F.lit("number:"), "number").alias("key"), F.col("c.ord").alias("slot"), F.col("c.name").alias("name"))
    near = checks.filter("size is not null and size <> 0").select(*LEGS, "ord", "name", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    near = near.join(rows.select(*LEGS, "size").distinct(), [*LEGS, "size"], "left_semi")
    stop = near.filter("name = ''").groupBy(*LEGS, "size").agg(F.min("ord").alias("stop"))
    by_amount = near.join(stop, [*LEGS, "size"], "left").filter("name <> '' and (stop is null or ord < stop)")
    by_amount = by_amount.select(*LEGS, F.concat(F.lit("amount:"), F.col("size").cast("string")).alias("key"), F.col("ord").alias("slot"), "name")
    lists = settled(by_number.unionByName(by_amount).groupBy(*LEGS, "key", "slot").agg(F.min("name").alias("name")))
    named = rows.join(last.select(*LEGS, "number", F.lit(True).alias("listed")), [*LEGS, "number"], "left")
    key = F.when(F.col("listed"), F.concat(F.lit("number:"), "number")).when(F.col("size").isNotNull(), F.concat(F.lit("amount:"), F.col("size").cast("string")))
    seekers = named.filter(key.isNotNull()).select(*LEGS, "turn", F.array(key).alias("keys"))
    choice = in_turn(seekers, lists.select(*LEGS, "key", "slot", F.col("slot").cast("decimal(38,0)").alias("preference")))
    filled = choice.chosen.join(lists, [*LEGS, "key", "slot"])
    return filled.select(*LEGS, F.floor(F.col("turn") / TURNS).alias("ord"), F.col("name").alias("__payee")), choice.rounds
