"""Overall scores of agent benchmarks: one aggregate a family, over parsed results beside their targets (one row a sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The query types that change a table, and the measures of a puzzle under their short names.
CHANGES = ("INSERT", "DELETE", "UPDATE")
PUZZLE = {"main": "progress", "SGA": "accuracy", "RE": "efficiency", "QR": "relevance", "GP": "progress"}
#: Hit points of a card game, and how a card score weighs wins and damage.
CARD_HP, WIN_SHARE, DAMAGE_SHARE = 1600, 0.7, 0.3


def puzzles(results: DataFrame, keys: list[str]) -> DataFrame:
    """Means over all samples of ``progress, accuracy, efficiency, relevance``; a sample without a result adds 0."""
    return results.groupBy(*keys).agg(*[(F.sum(F.coalesce(c, F.lit(0.0))) / F.count(F.lit(1))).alias(name) for name, c in PUZZLE.items()])


def answer_sets(results: DataFrame, keys: list[str]) -> DataFrame:
    """F1, exact match and executability of predicted sets (``predict, gold``); all samples count, those without a result as 0."""
    p, g = F.array_distinct("predict"), F.array_distinct("gold")
    both = F.size(F.array_intersect(p, g))
    some = F.col("predict").isNotNull()
    f1 = F.when(some & (both > 0), 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)
    same = some & (both == F.size(g)) & (both == F.size(p))
    return results.groupBy(*keys).agg(F.avg(f1).alias("f1"), F.avg(same.cast("double")).alias("em"), F.avg((some & (F.size("predict") > 0)).cast("double")).alias("executability"))


def mean_of_finished(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over the samples with a result; 0 without any."""
    return results.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value))


def same_rows(answer: Column, gold: Column, kind: Column) -> Column:
    """Whether a database answers right: changes by their whole answer, one value each as numbers where both are, else as sets."""
    a, g = F.element_at(answer, 1), F.element_at(gold, 1)
    one = F.coalesce(a.try_cast("double") == g.try_cast("double"), a == g)
    sets = (F.size(F.array_except(answer, gold)) == 0) & (F.size(F.array_except(gold, answer)) == 0)
    return F.when(kind.isin(*CHANGES), answer == gold).when((F.size(answer) == 1) & (F.size(gold) == 1), one).otherwise(sets)


def database(results: DataFrame, keys: list[str], types: tuple[str, ...]) -> DataFrame:
    """Accuracy by query type (``type, answer, gold``); SELECT takes in all that is neither INSERT nor UPDATE, and the overall score is the mean of the three.

    Samples without an answer don't count; a type without samples has 0.
    """
    right = same_rows(F.col("answer"), F.col("gold"), F.col("type")).cast("double")
    known = results.where(F.col("answer").isNotNull()).withColumn("_right", F.coalesce(right, F.lit(0.0)))
    of = {t: (F.col("type") == t) if t != "SELECT" else ~F.col("type").isin("INSERT", "UPDATE") for t in dict.fromkeys([*types, "SELECT", "INSERT", "UPDATE"])}
    means = known.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(c, F.col("_right"))), F.lit(0.0)).alias(f"{t}_accuracy") for t, c in of.items()])
    return means.withColumn("overall_cat_accuracy", (F.col("SELECT_accuracy") + F.col("INSERT_accuracy") + F.col("UPDATE_accuracy")) / 3)


def web_actions(results: DataFrame, keys: list[str]) -> DataFrame:
    """Element accuracy, mean word F1 of actions and share of steps right in both, in hundredths.

    ``element`` of ``gold_elements`` and ``action`` against ``gold_action``; a sample without an element or target adds 0.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.col(c), "\\s+"), lambda w: w != ""))
    p, g = words("action"), words("gold_action")
    both = F.size(F.array_intersect(p, g))
    known = F.col("element").isNotNull() & F.col("gold_elements").isNotNull()
    hit = F.when(known & F.array_contains("gold_elements", F.col("element")), 1.0).otherwise(0.0)
    f1 = F.when(~known, 0.0).when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both > 0, 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)
    made = results.withColumn("_hit", hit).withColumn("_f1", f1)
    step = ((F.col("_hit") > 0) & (F.col("_f1") >= 1.0)).cast("double")
    return made.groupBy(*keys).agg((F.avg("_hit") * 100).alias("element_acc"), (F.avg("_f1") * 100).alias("action_f1"), (F.avg(step) * 100).alias("step_sr"))


def card_games(results: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, damage and score of card games (``win_round, test_times, damage``); -1 where none was played."""
    sums = results.groupBy(*keys).agg(F.sum("win_round").alias("win_round"), F.sum("test_times").alias("total_round"), F.sum("damage").alias("_damage"), (F.count(F.lit(1)) * CARD_HP).alias("_hp"))
    rate = lambda x: F.when(F.col("total_round") == 0, -1.0).otherwise(x)
    win, damage = F.col("win_round") / F.nullif(F.col("total_round"), F.lit(0)), F.col("_damage") / F.col("_hp")
    return sums.select(*keys, "win_round", "total_round", rate(win).alias("win_rate"), rate(damage).alias("damage_rate"), rate(win * WIN_SHARE + F.least(F.lit(DAMAGE_SHARE), damage * DAMAGE_SHARE)).alias("score"))


def pass_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, those passed and not, and the share passed (``passed``; null: not)."""
    ok = F.coalesce("passed", F.lit(False))
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("pass"), F.count_if(~ok).alias("wrong"), F.avg(ok.cast("double")).alias("success_rate"))


#: Bounds of a belief in a cross-entropy, and the one that stands for an unknown.
SURE, UNKNOWN = (0.0001, 0.9999), 0.5


def role_beliefs(beliefs: DataFrame, game: list[str]) -> DataFrame:
    """What a player of hidden roles believed of each other one (``side`` 1 good, 0 evil; ``belief`` 0 to 1, -1 unknown), a row a game.

    ``deduction``: the share of players on whose side the belief is, from a half on good; ``cross_entropy``: the sum
    over players of ``-log`` of the belief in their true side, unknowns as a half.
    """
    right = (F.when(F.col("belief") >= UNKNOWN, 1).otherwise(0) == F.col("side")).cast("double")
    known = F.when(F.col("belief") == -1, UNKNOWN).otherwise(F.col("belief"))
    b = F.least(F.greatest(known, F.lit(SURE[0])), F.lit(SURE[1]))
    lost = -F.when(F.col("side") == 1, F.ln(b)).otherwise(F.ln(1 - b))
    return beliefs.groupBy(*game).agg(F.avg(right).alias("deduction"), F.sum(lost).alias("cross_entropy"))


def role_deception(beliefs: DataFrame, game: list[str]) -> DataFrame:
    """How good the other good players (``side`` 1) hold this one to be (``of_me``), a row a game; null in a game without good ones."""
    good = F.sum("side")
    return beliefs.groupBy(*game).agg(F.when(good > 0, F.sum(F.col("side") * F.col("of_me")) / good).alias("deception"))


def role_votes(rounds: DataFrame, game: list[str]) -> DataFrame:
    """``influence``: share of rounds whose outcome is the player's vote; ``leadership``: share approved of those that the player led, null without any."""
    return rounds.groupBy(*game).agg(F.avg((F.col("vote") == F.col("outcome")).cast("double")).alias("influence"), F.avg(F.when(F.col("leads"), F.col("outcome").cast("double"))).alias("leadership"))


def hidden_roles(games: DataFrame, scores: list[DataFrame], keys: list[str], game: str) -> DataFrame:
    """Win rate and mean deduction over all games of ``keys``, those not completed as 0; the other scores over the games that have them.

    ``games`` has a row a game with ``completed`` and ``won``; ``scores`` are the rows a game of the reducers above.
    """
    joined = games
    for one in scores:
        joined = joined.join(one, [*keys, game], "left")
    done = F.coalesce("completed", F.lit(False))
    of_all = lambda x: F.sum(F.when(done, F.coalesce(x, F.lit(0.0))).otherwise(0.0)) / F.count(F.lit(1))
    others = [c for c in joined.columns if c in ("cross_entropy", "deception", "influence", "leadership")]
    return joined.groupBy(*keys).agg(of_all(F.col("won").cast("double")).alias("win_rate"), of_all(F.col("deduction")).alias("deduction"), *[F.avg(F.when(done, F.col(c))).alias(c) for c in others])


#: Hit points that a card has at first.
CARD_HP_EACH = 400


def card_logs(frames: DataFrame, errors: DataFrame, tries: DataFrame, games: DataFrame, keys: list[str], game: str) -> DataFrame:
    """Totals of card games from their logs, a row for each of ``keys`` and each of two players.

    ``frames``: ``frame`` (from 0), ``player``, ``hp`` of each card; ``errors``: ``frame, place, player``; ``tries``:
    ``player, try_times``; ``games``: ``winner``. The last frame but one is the last round: what the other player's
    cards have lost there is a player's damage, those at 0 or below its takedowns, and the first error of the round
    its player's end before the full play. A game of one frame can't be read and is left out, as is one without cards
    in its last round.
    """
    group = [*keys, game]
    last = frames.groupBy(*group).agg((F.max("frame") - 1).alias("_last")).where("_last >= 0")
    lost = frames.join(last, group).where("frame = _last").groupBy(*group, (1 - F.col("player")).alias("player")).agg(F.sum(F.lit(CARD_HP_EACH) - F.greatest("hp", F.lit(0))).alias("damage"), F.count_if(F.col("hp") <= 0).alias("takedown"))
    read = lost.select(*group).distinct().join(last, group).join(games.select(*group, "winner"), group)
    first = errors.join(last, group).where("frame = _last").groupBy(*group).agg(F.min_by("player", "place").alias("_erred"))
    tried = tries.groupBy(*group, "player").agg(F.sum("try_times").alias("try_times"))
    both = read.withColumn("player", F.explode(F.array(F.lit(0), F.lit(1)))).join(lost, [*group, "player"], "left").join(first, group, "left").join(tried, [*group, "player"], "left")
    whole = F.coalesce(F.col("_erred") != F.col("player"), F.lit(True))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return both.groupBy(*keys, "player").agg(F.count_if(whole).alias("full_play"), total("try_times").alias("try_times"), total("takedown").alias("takedown"), total("damage").alias("damage"), F.count_if(F.col("winner") == F.col("player")).alias("win_round"), F.sum(F.col("_last") + 1).cast("long").alias("round_num"), F.count(F.lit(1)).alias("test_times"))


#: How a task's name tells its family (first match), where the family's result has its main metric, and what that is divided by.
MAIN_METRICS = [
    ("card|^cg|^dcg", "$.custom.score", 1.0),
    ("^alf", "$.custom.overall.success_rate", 1.0),
    ("^os|^operating", "$.custom.overall.acc", 1.0),
    ("^db|^database", "$.custom.overall_cat_accuracy", 1.0),
    ("^kg|^knowledge", "$.custom.main", 1.0),
    ("^ltp|^literal", "$.custom.main", 1.0),
    ("^m2w|^mind2web", "$.custom.step_sr", 100.0),
    ("^ws|^webshop", "$.custom.reward", 1.0),
]
#: Classes of a sample's end, and the statuses of each.
STATUS_CLASSES = {
    "Completed": ["COMPLETED"],
    "Context Limit Exceeded": ["AGENT_CONTEXT_LIMIT"],
    "Invalid Format": ["AGENT_VALIDATION_FAILED"],
    "Invalid Action": ["AGENT_INVALID_ACTION"],
    "Task Limit Exceeded": ["UNKNOWN", "TASK_ERROR", "TASK_LIMIT_REACHED"],
}


def main_metric(task: Column, result: Column) -> list[Column]:
    """``metric`` and ``legacy`` of an overall result (JSON): the number that stands for the task's family.

    A card game without a score gives its win rate, which is ``legacy``. Null for an unknown task.
    """
    name = F.lower(task)
    found = [(name.rlike(p), F.get_json_object(result, at).try_cast("double") / by) for p, at, by in MAIN_METRICS]
    metric = F.lit(None).cast("double")
    for matches, value in reversed(found):
        metric = F.when(matches, value).otherwise(metric)
    old = F.coalesce(name.rlike(MAIN_METRICS[0][0]) & metric.isNull(), F.lit(False))
    return [F.when(old, F.get_json_object(result, "$.custom.win_rate").try_cast("double")).otherwise(metric).alias("metric"), old.alias("legacy")]


def status_shares(samples: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Share of each class of ends among the samples of ``keys``: a row for each of ``keys`` and each class, those without samples with 0."""
    shares = samples.groupBy(*keys).agg(*[F.avg(F.coalesce(F.col(status).isin(*of), F.lit(False)).cast("double")).alias(name) for name, of in STATUS_CLASSES.items()])
    return shares.select(*keys, F.explode(F.create_map(*[x for name in STATUS_CLASSES for x in (F.lit(name), F.col(f"`{name}`"))])).alias("ending", "share"))


def validation_means(shares: DataFrame, by: str) -> DataFrame:
    """Unweighted mean of the shares over the pairs of each ``by``."""
    return shares.groupBy(by, "ending").agg(F.avg("share").alias("mean_share"))
