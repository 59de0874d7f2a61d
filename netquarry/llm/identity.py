"""Variant spellings of names typed by people: merge-and-rematch resolution.

Every record gives readings of its name and of its mailbox: a surname with a
given name, or with an initial only.  Records are matched through blocking keys;
matched records merge into profiles that hold the union of their spellings,
initials and mailboxes; the richer profiles enter blocking again, until a round
merges nothing.

Which of two words is the surname is told by the corpus itself: given names stand
beside many different words, surnames beside few.  A reading counts only if its
surname occurs as such, so that logins (``jsmith``, ``smithj``) are cut rightly.
Short forms and other spellings of given names are learnt as well: where a name and
the mailbox beside it have the same surname and different given names, for several
surnames and a share of those that the form occurs with (``aliases``).  ``PET_NAMES``
only adds what a table is too small to show.

A team is its organisation and what its name has besides, so that teams of one
organisation stay apart whatever their function is called; the organisation is the
word that is the domain of a mailbox or close to it, or that stands beside a usual
function, or else the longest.

What counts as a common name is a share of the table, not a number, so that
decisions do not change with its size.

Blocks never expand into pairs: equal keys are tied to their smallest record as a
star; spellings one typing error apart meet in blocks of a common deletion, in
which only distinct spellings (bounded by the alphabet and the word's length)
are compared.

Keys of a round
* same given name and surname; same given name and surnames one error apart; same
  surname and given names one error apart, unless both are common and alike in use;
* an initial with a surname joins the profile of that surname and initial if
  there is just one; without one, such readings join each other;
* a mailbox joins its records if they belong to one profile or none, and joins an
  initial to the one full profile of the same surname on it.  A mailbox on which
  several profiles occur is shared and no evidence.

Defined results
* a null or empty name is read from the mailbox; if that is null as well, or a
  role name stands beside a shared mailbox, the record stays alone;
* repeated names with equal mailboxes are one profile; extra columns are ignored;
* null ids are left out; an empty table gives no links.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.operators.components import connected

COMMON = 8  # partners from which a word is a common given name, in a table of up to COMMON / COMMON_SHARE full names
COMMON_SHARE = 0.0002  # the same as a share of the full names of a larger table
MENDED = 15  # times as many partners as its misspelling that a common name needs
ALIAS, ALIAS_SHARE = 3, 0.05  # surnames that show a short form, and their share of those that it occurs with

# Usual English short forms of given names that mean one name
PET_NAMES = {
    "tony": "anthony", "danny": "daniel", "dan": "daniel", "ed": "edward", "eddie": "edward", "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth",
    "jenny": "jennifer", "jen": "jennifer", "kate": "katherine", "kathy": "katherine", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "mike": "michael", "mick": "michael", "nick": "nicholas", "bob": "robert", "rob": "robert", "bobby": "robert", "tom": "thomas",
    "tommy": "thomas", "vicky": "victoria", "bill": "william", "will": "william", "billy": "william",
}
# Accounts that are no one's name, and the usual words of a team's and a firm's name
ROLES = frozenset(("dev", "root", "admin", "build", "builder", "ci", "git", "bot", "user", "test", "jenkins", "noreply", "nobody", "unknown"))
TEAM_HEADS = frozenset(("office", "off", "team", "tm", "group", "grp", "department", "dept", "division", "desk", "crew", "squad", "unit"))
TEAM_KINDS = frozenset(("research", "res", "silicon", "si", "devices", "dev", "systems", "sys", "inc", "ltd", "llc", "gmbh", "corp", "company", "labs"))
STEM = 5  # letters of a function's name that tell it: verif is verification
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower().replace("ø", "o").replace("æ", "ae").replace("ß", "ss").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def function_of(words: list[str]) -> str:
    """What tells a team's function: the beginnings of its words, in any order."""
    return "#" + "+".join(sorted(w[:STEM] for w in words))


def readings(text: str | None, domain: str | None = None) -> list[tuple[str | None, str, str, bool | None]]:
    """(given, initial, surname, oriented) readings of a typed name or a mailbox's local part.

    ``given`` is null where only the initial is known; ``oriented`` tells that the
    notation itself says which word is the surname, and is null where the initial
    stands apart from it.  For a team, the initial is ``#``, the surname its
    organisation and the given name its function; each long word of its name may be
    the organisation, the longest comes first.  A mailbox of one word may be that of
    a function.
    """
    if not text or not text.strip():
        return []
    s = fold(text.strip())
    s = re.sub(r"[-_. ]ws$", "", re.sub(r"^\d+\+", "", s))
    words = _WORD.findall(s)
    if not words:
        return []
    org = fold(domain).split(".")[0] if domain is not None else None
    if domain is not None and len(words) == 1 and words[0] in ROLES:
        return [(None, "#", org, False)]
    if len(words) > 1 and any(w in TEAM_HEADS for w in words):
        own = [w for w in words if w not in TEAM_HEADS and w not in TEAM_KINDS]
        orgs = sorted({w for w in own if len(w) > 4}, key=lambda w: (-len(w), w))
        return [(function_of([w for w in own if w != o]), "#", o, k == 0) for k, o in enumerate(orgs)]
    if len(words) == 1 and words[0] in ROLES:
        return []
    if "," in s and len(words) > 1:
        last = _WORD.findall(s.split(",")[0])
        rest = _WORD.findall(s.split(",", 1)[1])
        if last and rest:
            return [_reading(rest[0], last[-1], True)]
    long, single = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    if len(long) >= 2:
        return [_reading(long[0], long[-1], False), _reading(long[-1], long[0], False)]
    if len(long) == 1 and single:
        return [(None, single[0], long[0], None)]
    team = [(function_of(long), "#", org, None)] if org and len(words) == 1 and long else []
    if len(long) == 1 and len(long[0]) > 3:
        return [(None, long[0][0], long[0][1:], False), (None, long[0][-1], long[0][:-1], False), *team]
    return team


def _reading(given: str, surname: str, oriented: bool) -> tuple[str | None, str, str, bool]:
    return (given if len(given) > 1 else None, given[0], surname, oriented)


_READ = "identity bigint, source string, given string, initial string, surname string, oriented boolean, other string"


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    names = ["identity", "source", "given", "initial", "surname", "oriented", "other"]
    for batch in batches:
        rows = []
        for i, name, mail in zip(*(batch.column(c).to_pylist() for c in ("identity", "name", "mail"))):
            rows.extend((i, "name", *r, r[2]) for r in readings(name))
            if mail and "@" in mail:
                local, domain = mail.rsplit("@", 1)
                rows.extend((i, "mail", *r, r[2]) for r in readings(local, domain))
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


LONG = 40


def deletions(word: Column) -> Column:
    """Keys of which two words one error apart have one in common.

    A word and every string with one of its letters left out; for words above
    ``LONG`` letters, whose deletions would grow with their square, the leading and
    trailing halves, of which one error spares one.  Words next to that length have
    both kinds, so that one on either side of it has a key in common with the other.
    """
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    halves = []
    for less in (0, 1):
        h = F.floor(n / 2).cast("int") - less
        halves += [F.concat(F.lit("<"), F.substring(word, F.lit(1), h)), F.concat(F.lit(">"), F.substring(word, n - h + 1, h))]
    none = F.array().cast("array<string>")
    short, long = F.when(n <= LONG + 1, F.array_append(one, word)).otherwise(none), F.when(n >= LONG, F.array(*halves)).otherwise(none)
    return F.array_distinct(F.concat(short, long))


def one_error_apart(a: Column, b: Column) -> Column:
    """One letter added, left out or exchanged, or two neighbours swapped."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swapped


def aliases(read: DataFrame, records: DataFrame, pet_names: dict[str, str]) -> DataFrame:
    """(word, meant): short forms and other spellings of given names, the rarer form to the more frequent one.

    Learnt from names with one surname that stand beside one another: a record's
    name and its own mailbox, and the names of records with one mailbox (each to
    the most frequent of them).  A form counts that does so for at least ``ALIAS``
    surnames, and for ``ALIAS_SHARE`` of the surnames that it occurs with.
    """
    full = read.where("given is not null and initial <> '#'")
    name = full.where("source = 'name'").select("identity", "surname", F.col("given").alias("word"))
    own = name.join(full.where("source = 'mail'").select("identity", "surname", F.col("given").alias("other")), ["identity", "surname"]).select("surname", "word", "other")
    boxed = name.join(records.where("mail like '%@%'").select("identity", F.lower("mail").alias("box")), "identity").groupBy("box", "surname", "word").agg(F.count("*").alias("n"))
    hub = boxed.groupBy("box", "surname").agg(F.max(F.struct("n", "word")).getField("word").alias("other"))
    beside = own.unionByName(boxed.join(hub, ["box", "surname"]).select("surname", "word", "other")).where("word <> other")
    known = name.groupBy("word").agg(F.count_distinct("surname").alias("surnames"))
    both = beside.join(known, "word", "left").join(known.select(F.col("word").alias("other"), F.col("surnames").alias("others")), "other", "left").fillna(0, ["surnames", "others"])
    rarer = F.struct("surnames", "word") < F.struct(F.col("others").alias("surnames"), F.col("other").alias("word"))
    turned = both.select("surname", F.when(rarer, F.col("word")).otherwise(F.col("other")).alias("word"), F.when(rarer, F.col("other")).otherwise(F.col("word")).alias("meant"), F.least("surnames", "others").alias("surnames"))
    votes = turned.groupBy("word", "meant").agg(F.count_distinct("surname").alias("votes"), F.max("surnames").alias("surnames"))
    kept = votes.where((F.col("votes") >= ALIAS) & (F.col("votes") >= ALIAS_SHARE * F.col("surnames")))
    best = scratch.table(kept.groupBy("word").agg(F.max(F.struct("votes", "meant")).getField("meant").alias("meant")), "aliases")
    # a form of a form means what that means
    further = best.select(F.col("word").alias("meant"), F.col("meant").alias("further"))
    best = best.join(further, "meant", "left").select("word", F.coalesce("further", "meant").alias("meant")).where("word <> meant")
    fixed = read.sparkSession.createDataFrame(sorted(pet_names.items()), "word string, meant string") if pet_names else best.limit(0)
    return best.unionByName(fixed.join(best.select("word"), "word", "left_anti"))


def _common_names(read: DataFrame) -> tuple[DataFrame, int]:
    """(word, mended, partners): each first or last word as a given name, typing errors of common ones mended; and from how many partners one is common.

    ``partners`` is the number of different words beside it, or beside the common
    name that it is one error away from if that has ``MENDED`` times as many.
    """
    pairs = read.where("given is not null and initial <> '#'").select(F.col("given").alias("word"), F.col("other")).distinct()
    counts = scratch.table(pairs.groupBy("word").agg(F.count("*").alias("partners")), "partners")
    common = max(COMMON, round(COMMON_SHARE * (counts.agg(F.sum("partners")).first()[0] or 0)))
    usual = counts.where(F.col("partners") >= common).select(F.col("word").alias("given"), F.col("partners").alias("p2"), F.explode(deletions(F.col("word"))).alias("key"))
    keyed = counts.select("word", "partners", F.explode(deletions(F.col("word"))).alias("key")).join(usual, "key")
    mended = keyed.where(F.col("p2") >= MENDED * F.col("partners")).where(one_error_apart(F.col("word"), F.col("given")))
    best = mended.groupBy("word").agg(F.max(F.struct("p2", "given")).alias("best")).select("word", "best.given", "best.p2")
    out = counts.join(best, "word", "left")
    return out.select("word", F.coalesce("given", "word").alias("mended"), F.coalesce("p2", "partners").alias("partners")), common


def _teams(read: DataFrame, records: DataFrame) -> DataFrame:
    """The one reading of each team, and of mailboxes of such teams.

    Its organisation is the word that is a mailbox's domain, or else close to that of
    its own mailbox, or beside a usual function, or the longest.
    """
    domain = F.lower(F.regexp_extract("mail", r"@([^.@]+)[^@]*$", 1))
    boxes = records.where("mail like '%@%'").select("identity", domain.alias("domain"))
    domains = boxes.select(F.col("domain").alias("surname")).distinct().withColumn("known", F.lit(True))
    named = read.where("source = 'name' and initial = '#'").join(domains, "surname", "left").join(boxes, "identity", "left")
    # what stands beside a known organisation is a function
    usual = named.where("known").select("given").distinct().withColumn("usual", F.lit(True))
    named = named.join(usual, "given", "left").withColumn("near", F.coalesce(F.levenshtein("surname", "domain") <= 2, F.lit(False)))
    first = F.struct(F.col("known").isNull(), ~F.col("near"), F.col("usual").isNull(), ~F.col("oriented"), F.length("surname") * -1, "surname")
    columns = [F.col(c) for c in read.columns if c not in ("identity", "source")]
    one = named.groupBy("identity", "source").agg(F.min_by(F.struct(*columns), first).alias("r")).select("identity", "source", "r.*").select(read.columns)
    functions = one.select("given", "surname").distinct()
    box = read.where("source = 'mail' and initial = '#' and given is not null").join(functions, ["given", "surname"], "left_semi").select(read.columns)
    return one.withColumn("oriented", F.lit(True)).unionByName(box.withColumn("oriented", F.lit(True)))


def _valid_readings(records: DataFrame, pet_names: dict[str, str]) -> tuple[DataFrame, int]:
    """Readings whose surname is one, each record's name before its mailbox; and from how many partners a name is common."""
    raw = scratch.table(records.mapInArrow(_read_all, _READ), "readings")
    known_as = aliases(raw, records, pet_names)
    people = raw.where("not (initial = '#' and given is not null)")
    meant = people.join(known_as.select(F.col("word").alias("given"), F.col("meant").alias("g2")), "given", "left").join(known_as.select(F.col("word").alias("other"), F.col("meant").alias("o2")), "other", "left")
    meant = meant.withColumn("given", F.coalesce("g2", "given")).withColumn("other", F.coalesce("o2", "other")).select(raw.columns)
    read = scratch.table(meant.unionByName(_teams(raw, records)), "readings")
    scratch.drop(raw)
    words, common = _common_names(read)
    words = scratch.table(words, "words")
    nick = known_as.select("word").unionByName(known_as.select(F.col("meant").alias("word"))).distinct()
    as_given = words.select(F.col("word").alias("given"), "mended", F.col("partners").alias("given_n")).join(nick.select(F.col("word").alias("given"), F.lit(2).alias("given_nick")), "given", "left")
    as_surname = words.select(F.col("word").alias("other"), F.col("partners").alias("surname_n"))
    judged = read.where("given is not null").join(as_given, "given", "left").join(as_surname, "other", "left").join(nick.select(F.col("word").alias("other"), F.lit(2).alias("other_nick")), "other", "left")
    # the other reading of the same words has the surname as its given name
    score = F.coalesce("given_n", F.lit(0)) + F.coalesce("given_nick", F.lit(0))
    against = F.coalesce("surname_n", F.lit(0)) + F.coalesce("other_nick", F.lit(0))
    good = judged.where(F.col("oriented") | (score > against) | ((score == against) & (F.length("surname") >= F.length("given"))))
    good = scratch.table(good.withColumn("given", F.coalesce("mended", "given")).select(read.columns), "named")
    team_box = (F.col("initial") == "#") & (F.col("source") == "mail")
    # a word that stands more often as a given name is no surname
    as_either = good.where(~team_box).select("surname", F.lit(1).alias("n")).unionByName(good.where("initial <> '#'").select(F.col("given").alias("surname"), F.lit(-1).alias("n")))
    surnames = scratch.table(as_either.groupBy("surname").agg(F.sum("n").alias("n")).where("n > 0").select("surname"), "surnames")
    rest = read.where("given is null").join(surnames.withColumn("known", F.lit(True)), "surname", "left")
    # a login whose surname is nowhere else is its first letter and the rest, if it is long
    some = F.max(F.col("known")).over(Window.partitionBy("identity", "source"))
    rest = rest.withColumn("some", some)
    login = F.col("some").isNull() & F.col("oriented").isNotNull() & (F.col("initial") != "#") & (F.length("surname") >= 8)
    names = words.where(F.col("partners") >= common).select("word").unionByName(nick).unionByName(words.join(nick.select(F.col("word").alias("mended")), "mended", "left_semi").select("word")).distinct()
    rest = rest.withColumn("word", F.concat("initial", "surname")).join(names.withColumn("is_name", F.lit(True)), "word", "left")
    rest = rest.withColumn("is_name", F.max("is_name").over(Window.partitionBy("identity", "source")))
    login = login & F.col("is_name").isNull()
    weak = rest.where(F.col("known") | login).select(*read.columns, F.col("known").isNotNull().alias("known"))
    weak = weak.where("known").drop("known").unionByName(weak.where("not known").groupBy("identity", "source").agg(F.max_by(F.struct(*[c for c in read.columns if c not in ("identity", "source")]), F.concat(F.substring("surname", -7, 7), "initial")).alias("r")).select("identity", "source", "r.*").select(read.columns))
    weak = scratch.table(weak, "weak")
    named = good.where("source = 'name'").unionByName(weak.where("source = 'name'"))
    mail_read = good.where("source = 'mail'").join(surnames, "surname", "left_semi").select(read.columns).unionByName(weak.where("source = 'mail'"))
    own = named.select("identity", F.col("surname").alias("own_surname")).distinct()
    same = F.col("own_surname").isNull() | (F.levenshtein("own_surname", "surname") <= 2)
    mail_ok = mail_read.join(own, "identity", "left").where(same).select(read.columns)
    valid = scratch.table(named.unionByName(mail_ok).withColumn("full", F.col("given").isNotNull()).drop("oriented", "source", "other").distinct(), "valid")
    scratch.drop(read, words, good, surnames, weak)
    return valid, common


def _spelling_edges(full: DataFrame, common: int) -> DataFrame:
    """Stars over equal full names, and ties between spellings one error apart."""
    hubs = scratch.table(full.groupBy("given", "surname").agg(F.min("identity").alias("hub")), "hubs")
    stars = full.join(hubs, ["given", "surname"]).select(F.col("identity").alias("a"), F.col("hub").alias("b"))
    uses = hubs.groupBy("given").agg(F.count("*").alias("uses"))

    def near(same: str, differs: str, extra: Column) -> DataFrame:
        left = hubs.join(uses, "given").select(same, F.col(differs).alias("x"), F.col("hub").alias("a"), F.col("uses").alias("c1"), F.explode(deletions(F.col(differs))).alias("key"))
        right = left.select(same, F.col("x").alias("y"), F.col("a").alias("b"), F.col("c1").alias("c2"), "key")
        return left.join(right, [same, "key"]).where("x < y").where(one_error_apart(F.col("x"), F.col("y"))).where(extra).select("a", "b").distinct()

    return stars.unionByName(near("given", "surname", F.lit(True))).unionByName(near("surname", "given", (F.least("c1", "c2") < common) | (F.greatest("c1", "c2") >= 4 * F.least("c1", "c2"))))


def _rematch(profiles: DataFrame, records: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges between profiles found by their united spellings, initials and mailboxes."""
    own = valid.join(profiles, "identity")
    canon = F.when(F.col("full"), F.array_distinct(F.array(F.col("initial"), F.substring("given", 1, 1)))).otherwise(F.array("initial"))
    forms = scratch.table(own.select("profile", "surname", F.explode(canon).alias("initial"), "full").groupBy("profile", "surname", "initial").agg(F.max("full").alias("full")), "forms")
    # an initial with a surname, and the full profiles it may mean
    fulls = forms.where("full").groupBy("surname", "initial").agg(F.count_distinct("profile").alias("n"), F.min("profile").alias("b"))
    named = forms.where("full").select("profile").distinct()
    weak = forms.where("not full").join(named, "profile", "left_anti")
    seek = weak.join(fulls, ["surname", "initial"], "left")
    one = seek.where("n = 1").select(F.col("profile").alias("a"), "b")
    alone = seek.where("n is null").groupBy("surname", "initial").agg(F.min("profile").alias("b"))
    together = seek.where("n is null").drop("b").join(alone, ["surname", "initial"]).select(F.col("profile").alias("a"), "b")
    # mailboxes
    box = scratch.table(records.where("mail is not null and mail <> ''").select("identity", F.lower("mail").alias("box")).join(profiles, "identity"), "boxes")
    known = valid.join(profiles, "identity").groupBy("profile").agg(F.max("full").alias("full"))
    at_box = box.select("box", "profile").distinct().join(known, "profile", "left")
    per_box = at_box.groupBy("box").agg(F.count("full").alias("n"), F.min(F.when(F.col("full").isNotNull(), F.col("profile"))).alias("named"), F.min("profile").alias("first"))
    nameless = at_box.where("full is null").join(per_box, "box").where("n <= 1").select(F.col("profile").alias("a"), F.coalesce("named", "first").alias("b"))
    with_name = at_box.where("full is not null").join(forms.select("profile", "surname").distinct(), "profile")
    owner = with_name.where("full").groupBy("box", "surname").agg(F.count_distinct("profile").alias("n"), F.min("profile").alias("b")).where("n = 1")
    by_box = with_name.where("not full").join(owner, ["box", "surname"]).select(F.col("profile").alias("a"), "b")
    return one.unionByName(together).unionByName(nameless).unionByName(by_box).where("a <> b").distinct()


def resolve(records: DataFrame, pet_names: dict[str, str] | None = None) -> DataFrame:
    """(identity, profile) for ``records(identity bigint, name, mail)``; the profile is its smallest identity."""
    records = scratch.table(records.where("identity is not null").select("identity", "name", "mail"), "records")
    valid, common = _valid_readings(records, PET_NAMES if pet_names is None else pet_names)
    at = connected(_spelling_edges(valid.where("full").select("identity", "given", "surname").distinct(), common))
    all_ids = records.select("identity").distinct()
    profiles = scratch.table(all_ids.join(at.select(F.col("node").alias("identity"), "component"), "identity", "left").select("identity", F.coalesce("component", "identity").alias("profile")), "profiles")
    while True:
        edges = scratch.table(_rematch(profiles, records, valid), "edges")
        if not edges.limit(1).count():
            scratch.drop(edges, records, valid)
            return profiles
        merged = connected(edges).select(F.col("node").alias("profile"), F.col("component").alias("into"))
        new = scratch.table(profiles.join(merged, "profile", "left").select("identity", F.coalesce("into", "profile").alias("profile")), "profiles")
        scratch.drop(edges, profiles)
        profiles = new


PARTS = 1_000  # identities of a profile that are paired with all of it in one task


def linked_pairs(profiles: DataFrame, part: int = PARTS) -> DataFrame:
    """(identity_a, identity_b) of every two identities of one profile, the smaller first.

    A profile of more than ``part`` identities is cut into parts, each of which
    meets the whole profile in a task of its own.
    """
    parts = profiles.groupBy("profile").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    sized = profiles.join(parts, "profile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = sized.select("profile", F.pmod(F.xxhash64("identity"), F.col("parts")).cast("int").alias("part"), F.col("identity").alias("identity_a"))
    right = sized.select("profile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("identity").alias("identity_b"))
    return left.join(right, ["profile", "part"]).where("identity_a < identity_b").select("identity_a", "identity_b")
