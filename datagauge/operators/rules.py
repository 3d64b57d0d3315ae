"""Record rules: one scan checks them all.

Every alternative of a rule has a code. A row's rules give an array of fired codes, which is exploded; what a code
stands for is looked up in literal arrays, and message texts are put together for fired codes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.functions.dates import date_of, is_date_format, parse_date
from datagauge.functions.numbers import to_number
from datagauge.functions.text import matches, strip
from datagauge.params import PATTERNS

@dataclass(frozen=True)
class FieldNames:
    """The field names the rules look for, in the order they are tried."""

    record_id: tuple = ("user_id", "id", "userId", "ID", "User_ID", "employee_id", "emp_id", "EMP_ID")
    name: tuple = (
        "name", "user", "username", "first_name", "fullname", "user_name", "employee_name", "full_name",
    )
    email: tuple = ("email", "email_address", "mail", "e_mail", "work_email", "company_email")
    age: tuple = ("age", "Age", "user_age", "employee_age")
    signup: tuple = (
        "signup_date", "created_at", "registration_date", "join_date", "created", "signup", "hire_date", "start_date",
    )
    purchases: tuple = (
        "purchase_date", "last_purchase", "purchase_dates", "order_date", "transaction_date",
        "project_end_date", "completion_date",
    )
    dates: tuple = (
        "hire_date", "signup_date", "created_date", "birth_date", "last_login", "registration_date",
        "start_date", "end_date",
    )
    past_dates: tuple = ("hire_date", "signup_date", "birth_date", "created_date")
    date_pairs: tuple = (
        ("start_date", "end_date"), ("hire_date", "termination_date"), ("signup_date", "last_login"),
        ("created_date", "updated_date"), ("birth_date", "hire_date"),
    )
    required: tuple = ("id", "user_id", "employee_id", "emp_id", "customer_id")
    booleans: tuple = ("is_active", "is_remote", "is_deleted", "is_verified", "is_admin", "is_enabled")
    non_negative: tuple = (
        "years_experience", "employee_count", "revenue", "budget", "hours_worked", "commission",
    )
    percentages: tuple = ("completion_rate", "success_rate", "discount_rate", "tax_rate", "commission_rate")
    formatted_ids: tuple = ("employee_id", "customer_id", "account_id", "order_id")


@dataclass(frozen=True)
class ComponentSum:
    """A total that must equal the signed sum of other fields of its record; a missing part is zero."""

    total: str
    added: tuple[str, ...]
    subtracted: tuple[str, ...] = ()
    tolerance: float = 0.01


@dataclass(frozen=True)
class LineSum:
    """A total that must equal the sum over the lines of its record; a record without lines has a sum of zero."""

    total: str
    key: str
    lines: DataFrame
    line_key: str
    amount: Column
    tolerance: float = 0.01


@dataclass(frozen=True)
class RuleSet:
    """Fixed values of the rules, plus further rules: functions of a frame that give issue columns."""

    fields: FieldNames = field(default_factory=FieldNames)
    categories: dict = field(
        default_factory=lambda: {
            "department": ("HR", "Finance", "Engineering", "Sales", "Marketing", "Operations", "IT", "Legal"),
            "status": ("Active", "Inactive", "Pending", "Suspended", "Terminated"),
            "priority": ("Low", "Medium", "High", "Critical"),
            "gender": ("Male", "Female", "Other", "Prefer not to say"),
        }
    )
    placeholder_names: tuple = ("null", "none", "n/a", "unknown", "test", "admin")
    invalid_names: tuple = ("test", "admin", "user", "null", "undefined", "anonymous")
    placeholder_dates: tuple = ("invalid-date", "invalid_date", "null", "none", "n/a", "", "0000-00-00")
    placeholder_ids: tuple = ("null", "none", "n/a", "undefined")
    boolean_words: tuple = ("true", "false", "1", "0", "yes", "no")
    test_domains: tuple = ("test.com", "example.com", "fake.com", "temp.com", "dummy.com")
    disposable_parts: tuple = ("temp", "throw", "fake", "test", "10min")
    statistical_bounds: dict = field(
        default_factory=lambda: {
            "salary": (15000, 1000000), "age": (16, 100), "years_experience": (0, 50),
            "performance_rating": (0.0, 5.0),
        }
    )
    extra: tuple = ()
    # What only the table's owner knows: the fields that identify a record, and the totals.
    unique: tuple[str, ...] = ()
    sums: tuple[ComponentSum | LineSum, ...] = ()


DEFAULT_RULES = RuleSet()


# --- field resolution ---------------------------------------------------------------------------------------------


def _existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _as_text(df: DataFrame, name: str) -> Column:
    return C.text_form(df, name)


def _first_text(df: DataFrame, names: Sequence[str]) -> Column:
    found = _existing(df, names)
    return F.coalesce(*[_as_text(df, n) for n in found]) if found else F.lit(None).cast("string")


def record_id(df: DataFrame, rules: RuleSet = DEFAULT_RULES, row_index: Column | None = None) -> Column:
    """The first id field that is not null, else ``Record_`` and the row position."""
    position = F.monotonically_increasing_id() if row_index is None else row_index
    fallback = F.concat(F.lit("Record_"), position.cast("string"))
    return F.coalesce(_first_text(df, rules.fields.record_id), fallback)


def record_name(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> Column:
    return F.coalesce(strip(_first_text(df, rules.fields.name)), F.lit(""))


def record_email(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> Column:
    return F.coalesce(strip(_first_text(df, rules.fields.email)), F.lit(""))


def record_age(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> Column:
    """The first age field that reads as a whole number; fractions of numeric columns are cut off."""
    tried = []
    for n in _existing(df, rules.fields.age):
        kind = C.families(df)[n]
        if kind == "string":
            text = strip(C.col(n))
            tried.append(F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_")).try_cast("bigint")))
        else:
            tried.append(C.col(n).cast("bigint"))
    return F.coalesce(*tried) if tried else F.lit(None).cast("bigint")


def signup_date(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> Column:
    """The first sign-up field that is not null, as text."""
    return _first_text(df, rules.fields.signup)


def purchase_dates(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> Column:
    """All purchase dates of a record as an array of text."""
    kinds = C.families(df)
    parts = []
    for n in _existing(df, rules.fields.purchases):
        if kinds[n] == "array":
            parts.append(F.coalesce(F.transform(C.col(n), lambda d: d.cast("string")), F.array().cast("array<string>")))
        else:
            parts.append(F.array(_as_text(df, n)))
    if not parts:
        return F.array().cast("array<string>")
    return F.array_compact(F.flatten(F.array(*parts)))


# --- rules ----------------------------------------------------------------------------------------------------------


class Checks:
    """Collects the rules of one frame: conditions that yield codes, and what each code stands for."""

    def __init__(self, df: DataFrame, as_of: str, rules: RuleSet):
        self.df, self.rules = df, rules
        self.today = F.lit(as_of).cast("date")
        self.meanings: list[tuple[str, str, str, str, str]] = []
        self.messages: list[Column] = []
        self.values: list[tuple[Column, Column]] = []
        self.single: list[Column] = []
        self.per_purchase: list = []

    def issue(self, rule: str, kind: str, category: str, severity: str, name: str, *tail, expected: Column | str | None = None) -> int:
        """Registers an issue and gives its code; ``tail`` is the message after the user, as texts and columns.
        ``expected`` is what the field should hold, where the rule knows it."""
        words = [F.lit(kind + ": User "), F.col("_record_id")]
        words += [F.lit(t) if isinstance(t, str) else t.cast("string") for t in tail]
        self.meanings.append((rule, kind, category, severity, name))
        self.messages.append(F.concat(*[F.coalesce(w, F.lit("None")) for w in words]))
        resolved = {"purchase_date": "_item", "signup_date": "_signup", "name": "_name", "email": "_email", "age": "_age"}
        actual = self.text(name) if name in self.df.columns else F.col(resolved[name]).cast("string") if name in resolved else F.lit(None).cast("string")
        self.values.append((actual, (F.lit(expected) if expected is None or isinstance(expected, str) else expected).cast("string")))
        return len(self.messages) - 1

    def add(self, *cases: tuple[Column, int]) -> None:
        """One rule with alternatives; the first condition that holds gives the issue."""
        chain = F.when(cases[0][0], F.lit(cases[0][1]))
        for condition, code in cases[1:]:
            chain = chain.when(condition, F.lit(code))
        self.single.append(chain)

    def number(self, name: str) -> Column:
        if C.families(self.df)[name] == "string":
            return to_number(C.col(name))
        return C.col(name).cast("double")

    def text(self, name: str) -> Column:
        return _as_text(self.df, name)

    def day(self, name: str) -> Column:
        """The parsed date of a date field."""
        return C.col(f"_day {name}")


def _temporal(k: Checks) -> None:
    signup, day = F.col("_signup"), F.col("_signup_day")
    years = F.date_diff(k.today, day) / 365.25
    k.add((day > k.today, k.issue("V02", "CRITICAL", "future_dates", "CRITICAL", "signup_date", " has future signup date: ", signup)))
    k.add((
        years > 50,
        k.issue("V03", "TEMPORAL ANOMALY", "temporal_issues", "LOW", "signup_date", " has signup date ",
                F.format_string("%.1f", years), " years ago: ", signup),
    ))

    if _existing(k.df, k.rules.fields.purchases):
        text = F.col("_item")
        future = k.issue("V04", "CRITICAL", "future_dates", "CRITICAL", "purchase_date", " has future purchase date: ", text)
        early = k.issue("V05", "LOGICAL ERROR", "impossible_sequences", "HIGH", "purchase_date",
                        " purchased (", text, ") before signup (", signup, ")")
        k.per_purchase.append((future, lambda bought: bought > k.today))
        k.per_purchase.append((early, lambda bought: bought < day))


def _cross_field(k: Checks) -> None:
    name, email, age = F.col("_name"), F.col("_email"), F.col("_age")
    local, a, b = F.col("_local"), F.col("_plain_name"), F.col("_plain_local")
    prefix = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(b, F.substring(a, 1, 3)) | F.contains(a, F.substring(b, 1, 3)))
    similar = (a == "") | (b == "") | F.contains(b, a) | F.contains(a, b) | prefix
    comparable = email.contains("@") & (F.length(name) > 2) & (F.length(local) > 2)
    k.add((
        comparable & ~similar,
        k.issue("V06", "CROSS-FIELD MISMATCH", "cross_field_issues", "MEDIUM", "name", " name '", name,
                "' doesn't match email '", email, "' (local: ", local, ")"),
    ))
    then = age - F.date_diff(k.today, F.col("_signup_day")) / 365.25
    told = F.format_string("%.1f", then)
    k.add(
        (then < 13, k.issue("V07", "AGE INCONSISTENCY", "age_inconsistencies", "MEDIUM", "age", " would have been ", told, " years old at signup (too young)")),
        (then > 100, k.issue("V07", "AGE INCONSISTENCY", "age_inconsistencies", "MEDIUM", "age", " would have been ", told, " years old at signup (unrealistic)")),
    )


def _email(k: Checks) -> None:
    email = F.col("_email")
    bad = (email != "") & ~F.col("_email_ok")
    k.add((bad, k.issue("V08", "EMAIL FORMAT ERROR", "email_format_issues", "HIGH", "email", " has invalid email format: '", email, "'")))


def _age_and_salary(k: Checks) -> None:
    age = F.col("_age")
    k.add(
        (age < 0, k.issue("V09", "IMPOSSIBLE VALUE", "business_logic_issues", "CRITICAL", "age", " has negative age: ", age)),
        (age > 150, k.issue("V09", "UNREALISTIC VALUE", "business_logic_issues", "HIGH", "age", " has age over 150: ", age)),
        (age < 13, k.issue("V09", "BUSINESS RULE VIOLATION", "business_logic_issues", "MEDIUM", "age", " below minimum age requirement: ", age)),
    )
    if "salary" not in k.df.columns:
        return
    shown, pay = k.text("salary"), k.number("salary")
    k.add(
        (C.col("salary").isNull(), k.issue("V10", "MISSING REQUIRED FIELD", "missing_required_fields", "CRITICAL", "salary", " has null/missing salary")),
        (pay.isNull(), k.issue("V10", "INVALID FORMAT", "data_type_violations", "HIGH", "salary", " has non-numeric salary: ", shown)),
        (pay < 0, k.issue("V10", "IMPOSSIBLE VALUE", "business_logic_issues", "CRITICAL", "salary", " has negative salary: ", shown)),
        (pay > 10000000, k.issue("V10", "UNREALISTIC VALUE", "business_logic_issues", "HIGH", "salary", " has extremely high salary: ", shown)),
        (pay < 15000, k.issue("V10", "BUSINESS RULE VIOLATION", "business_logic_issues", "MEDIUM", "salary", " salary below minimum threshold: ", shown)),
        (pay > 1000000, k.issue("V10", "REVIEW REQUIRED", "business_logic_issues", "LOW", "salary", " has unusually high salary requiring validation: ", shown)),
    )


def _name(k: Checks) -> None:
    name = F.col("_name")
    lowered, size = F.lower(name), F.length(name)
    proper = matches(name, r"^[a-zA-Z\s\-'\.]+$") & ~lowered.isin(*k.rules.invalid_names) & name.rlike("[a-zA-Z]")
    k.add(
        ((name == "") | lowered.isin(*k.rules.placeholder_names), k.issue("V11", "MISSING REQUIRED FIELD", "missing_required_fields", "CRITICAL", "name", " has empty or invalid name")),
        (size < 2, k.issue("V11", "BUSINESS RULE VIOLATION", "business_logic_issues", "MEDIUM", "name", " name too short: '", name, "'")),
        (size > 100, k.issue("V11", "BUSINESS RULE VIOLATION", "business_logic_issues", "MEDIUM", "name", " name too long: '", name, "'")),
        (~proper, k.issue("V12", "INVALID FORMAT", "data_type_violations", "HIGH", "name", " has invalid name format: '", name, "'")),
    )


def _dates(k: Checks) -> None:
    for n in _existing(k.df, k.rules.fields.dates):
        raw, typed = k.text(n), C.families(k.df)[n] == "datetime"
        text, day = strip(raw), k.day(n)
        placeholder = F.lit(False) if typed else F.lower(text).isin(*k.rules.placeholder_dates)
        malformed = F.lit(False) if typed else ~is_date_format(text)
        cases = [
            (placeholder, k.issue("V13", "INVALID DATE FORMAT", "data_type_violations", "HIGH", n, f" has invalid {n}: '", raw, "'")),
            (malformed, k.issue("V13", "INVALID DATE FORMAT", "data_type_violations", "HIGH", n, f" has malformed {n}: '", raw, "'")),
        ]
        usable = ~placeholder & ~malformed
        if not typed:
            k.add(*cases)
        if n in k.rules.fields.past_dates:
            k.add((usable & (day > k.today), k.issue("V14", "BUSINESS RULE VIOLATION", "future_dates", "CRITICAL", n, f" has future {n}: ", text)))
        if n == "birth_date":
            k.add(
                (usable & (F.year(day) < 1900), k.issue("V15", "UNREALISTIC VALUE", "business_logic_issues", "HIGH", n, " has birth_date before 1900: ", text)),
                (usable & (F.date_diff(k.today, day) > 150 * 365), k.issue("V15", "UNREALISTIC VALUE", "business_logic_issues", "HIGH", n, " has birth_date indicating age over 150: ", text)),
            )
    for start, end in k.rules.fields.date_pairs:
        if start in k.df.columns and end in k.df.columns:
            a, b = k.day(start), k.day(end)
            k.add((a > b, k.issue("V16", "IMPOSSIBLE SEQUENCE", "impossible_sequences", "HIGH", start, f" has {start} (", a, f") after {end} (", b, ")")))


def _business_email(k: Checks) -> None:
    email = F.col("_email")
    domain = F.split_part(F.lower(email), F.lit("@"), F.lit(2))
    throwaway = domain.isin(*k.rules.test_domains) | domain.rlike("|".join(k.rules.disposable_parts))
    cases = [
        ((email != "") & ~F.col("_email_ok"), k.issue("V18", "INVALID EMAIL FORMAT", "email_format_issues", "HIGH", "email", " has invalid email: '", email, "'")),
        ((email != "") & throwaway, k.issue("V18", "BUSINESS RULE VIOLATION", "business_logic_issues", "MEDIUM", "email", " has non-business email format: '", email, "'")),
    ]
    if "email" in k.df.columns:
        cases.append((email == "", k.issue("V18", "MISSING REQUIRED FIELD", "missing_required_fields", "CRITICAL", "email", " has empty email")))
    k.add(*cases)


def _typed_fields(k: Checks) -> None:
    names = k.rules.fields
    for n in _existing(k.df, names.required):
        empty = C.col(n).isNull() | (strip(k.text(n)) == "")
        k.add((empty, k.issue("V19", "MISSING REQUIRED FIELD", "missing_required_fields", "CRITICAL", n, f" has empty {n}")))
    for n in _existing(k.df, names.booleans):
        if C.families(k.df)[n] != "boolean":
            value = k.text(n)
            k.add((~F.lower(value).isin(*k.rules.boolean_words), k.issue("V20", "INVALID BOOLEAN VALUE", "data_type_violations", "HIGH", n, f" has invalid {n}: '", value, "'")))
    for n in _existing(k.df, names.non_negative):
        x = k.number(n)
        cases = [(x < 0, k.issue("V21", "IMPOSSIBLE VALUE", "business_logic_issues", "CRITICAL", n, f" has negative {n}: ", x))]
        if n == "years_experience":
            cases.append((x > 70, k.issue("V21", "UNREALISTIC VALUE", "business_logic_issues", "HIGH", n, f" has excessive {n}: ", x)))
        if n == "hours_worked":
            cases.append((x > 168, k.issue("V21", "IMPOSSIBLE VALUE", "business_logic_issues", "CRITICAL", n, f" has {n} exceeding weekly limit: ", x)))
        cases.append((C.col(n).isNotNull() & x.isNull(), k.issue("V21", "INVALID FORMAT", "data_type_violations", "HIGH", n, f" has non-numeric {n}: '", k.text(n), "'")))
        k.add(*cases)
    for n in _existing(k.df, names.percentages):
        x = k.number(n)
        k.add(
            ((x < 0) | (x > 100), k.issue("V22", "OUT OF RANGE", "business_logic_issues", "MEDIUM", n, f" has {n} outside 0-100%: ", x)),
            (C.col(n).isNotNull() & x.isNull(), k.issue("V22", "INVALID FORMAT", "data_type_violations", "HIGH", n, f" has non-numeric {n}: '", k.text(n), "'")),
        )
    phones = _existing(k.df, ("phone", "phone_number"))
    if phones:
        phone = F.coalesce(*[F.when(k.text(n) != "", k.text(n)) for n in phones])
        digits = F.regexp_replace(phone, r"[\s\-\(\)\+\.]", "")
        k.add((~digits.rlike(r"^\p{Nd}{7,15}\z"), k.issue("V23", "INVALID PHONE FORMAT", "data_type_violations", "HIGH", phones[0], " has invalid phone number: '", phone, "'")))
    for n in _existing(k.df, names.formatted_ids):
        value = strip(k.text(n))
        size = F.length(value)
        k.add(
            (size == 0, k.issue("V24", "MISSING REQUIRED FIELD", "missing_required_fields", "CRITICAL", n, f" has empty {n}")),
            (F.lower(value).isin(*k.rules.placeholder_ids), k.issue("V24", "INVALID ID FORMAT", "data_type_violations", "HIGH", n, f" has invalid {n}: '", value, "'")),
            (size < 2, k.issue("V24", "INVALID ID FORMAT", "data_type_violations", "HIGH", n, f" has {n} too short: '", value, "'")),
            (size > 50, k.issue("V24", "INVALID ID FORMAT", "data_type_violations", "HIGH", n, f" has {n} too long: '", value, "'")),
        )
    for n, allowed in k.rules.categories.items():
        if n in k.df.columns:
            value = strip(k.text(n))
            expected = f"' (expected: {', '.join(allowed)})"
            k.add(((value != "") & ~value.isin(*allowed), k.issue("V25", "INVALID CATEGORY", "business_logic_issues", "MEDIUM", n, f" has invalid {n}: '", value, expected, expected=", ".join(allowed))))


def _statistical(k: Checks) -> None:
    for n, (low, high) in k.rules.statistical_bounds.items():
        if n in k.df.columns:
            x = k.number(n)
            word = "out-of-range" if n == "performance_rating" else "unusual"
            k.add(((x > high) | (x < low), k.issue("V26", "STATISTICAL ANOMALY", "statistical_anomalies", "MEDIUM", n, f" has {word} {n}: ", x, expected=f"{low} to {high}")))


def _table_wide(k: Checks) -> None:
    """Rules that look at other rows: ids that repeat, and totals, which may be made of lines elsewhere."""
    for i, n in enumerate(_existing(k.df, k.rules.unique)):
        copies = F.col(f"_copies {i}")
        k.add((copies > 1, k.issue("V28", "DUPLICATE ID", "business_logic_issues", "CRITICAL", n, f" has {n} '", k.text(n), "' that ", copies, " records share", expected="a value of its own")))
    for i, rule in enumerate(k.rules.sums):
        if rule.total in k.df.columns:
            actual, expected = k.number(rule.total), F.col(f"_expected {i}")
            made_of = "the sum of its lines" if isinstance(rule, LineSum) else " + ".join(rule.added) + "".join(f" - {c}" for c in rule.subtracted)
            off = F.abs(actual - expected) > rule.tolerance
            k.add((off, k.issue("V27", "CALCULATION ERROR", "business_logic_issues", "CRITICAL", rule.total, f" has {rule.total} ", actual, f", not {made_of}: ", expected, expected=expected)))


GROUPS = (_temporal, _cross_field, _email, _age_and_salary, _name, _dates, _business_email, _typed_fields, _statistical, _table_wide)


def _fired(checks: Checks) -> Column:
    """Array of ``(code, item)``; the item is the purchase date a repeated rule fired on."""
    codes = F.array_compact(F.array(*checks.single))
    plain = F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("item")))
    if not checks.per_purchase:
        return plain

    def of_purchase(text: Column) -> Column:
        hits = [F.when(test(parse_date(text)), F.lit(code)) for code, test in checks.per_purchase]
        return F.transform(F.array_compact(F.array(*hits)), lambda c: F.struct(c.alias("code"), text.alias("item")))

    return F.concat(plain, F.flatten(F.transform(F.col("_purchases"), of_purchase)))


def _prepared(df: DataFrame, rules: RuleSet, row_index: Column | None) -> DataFrame:
    """Adds what several rules read, so that it is computed once per row: resolved fields, parsed dates, plain names."""
    names = rules.fields
    dated = dict.fromkeys([*names.dates, *(n for pair in names.date_pairs for n in pair)])
    resolved = df.select(
        "*",
        record_id(df, rules, row_index).alias("_record_id"),
        record_name(df, rules).alias("_name"),
        record_email(df, rules).alias("_email"),
        record_age(df, rules).alias("_age"),
        signup_date(df, rules).alias("_signup"),
        purchase_dates(df, rules).alias("_purchases"),
        *[date_of(df, n).alias(f"_day {n}") for n in _existing(df, dated)],
    )
    lowered = F.lower("_name")
    first = F.when(lowered.contains(" "), F.regexp_extract(lowered, r"^\S+", 0)).otherwise(lowered)
    return resolved.select(
        "*",
        parse_date(F.col("_signup")).alias("_signup_day"),
        F.lower(F.split_part("_email", F.lit("@"), F.lit(1))).alias("_local"),
        F.regexp_replace(first, "[^a-z]", "").alias("_plain_name"),
        matches(F.col("_email"), PATTERNS["email"]).alias("_email_ok"),
    ).withColumn("_plain_local", F.regexp_replace("_local", "[0-9._-]", ""))


def _with_table_facts(resolved: DataFrame, df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds how many records share an id, and what a total should be.

    Ids and lines are folded to one row for each key before they meet the records, and only ids that repeat do; a
    null or empty id is no id. A key that many records share is split by the join.
    """
    for i, n in enumerate(_existing(df, rules.unique)):
        repeated = df.select(C.present(df, n).alias(f"_id {i}")).where(C.col(f"_id {i}").isNotNull()).groupBy(C.col(f"_id {i}")).agg(F.count("*").alias(f"_copies {i}"))
        resolved = resolved.join(repeated.where(F.col(f"_copies {i}") > 1), C.col(n) == F.col(f"_id {i}"), "left")
    for i, rule in enumerate(rules.sums):
        if rule.total not in df.columns:
            continue
        if isinstance(rule, LineSum):
            sums = rule.lines.groupBy(C.col(rule.line_key).alias(f"_key {i}")).agg(F.sum(rule.amount).cast("double").alias(f"_sum {i}"))
            resolved = resolved.join(sums, C.col(rule.key) == F.col(f"_key {i}"), "left").withColumn(f"_expected {i}", F.coalesce(F.col(f"_sum {i}"), F.lit(0.0)))
        else:
            parts = [(c, 1.0) for c in rule.added] + [(c, -1.0) for c in rule.subtracted]
            number = {c: to_number(C.col(c)) if C.families(df)[c] == "string" else C.col(c).cast("double") for c, _ in parts}
            resolved = resolved.withColumn(f"_expected {i}", sum((F.coalesce(number[c], F.lit(0.0)) * sign for c, sign in parts), F.lit(0.0)))
    return resolved


def record_issues(
    df: DataFrame,
    as_of_date: str,
    rules: RuleSet = DEFAULT_RULES,
    row_index: Column | None = None,
    mode: str = "structured",
    values: bool = False,
) -> DataFrame:
    """``(record_id, rule, kind, category, severity, field, message)``, one row per issue; with ``values`` also
    ``(actual, expected)`` as text: what the field holds, and what it should hold where the rule knows it.

    ``structured``: the rule states category and severity. ``keyword``: both are read off the message, by
    ``datagauge.operators.issues``. ``rules.extra`` holds further groups: functions that add to the ``Checks``.
    """
    prepared = _with_table_facts(_prepared(df, rules, row_index), df, rules)
    checks = Checks(df, as_of_date, rules)
    for group in (*GROUPS, *rules.extra):
        group(checks)
    # The outer form keeps the optimizer from testing every rule a second time to find rows without issues.
    hits = prepared.withColumn("_hit", F.explode_outer(_fired(checks))).where("_hit is not null")
    hits = hits.select("*", F.col("_hit.code").alias("_code"), F.col("_hit.item").alias("_item"))

    def meaning(position: int) -> Column:
        return F.get(F.array(*[F.lit(m[position]) for m in checks.meanings]), F.col("_code"))

    def text_of(position: int) -> Column:
        known = [(code, pair[position]) for code, pair in enumerate(checks.values)]
        out = F.when(F.col("_code") == known[0][0], known[0][1])
        for code, value in known[1:]:
            out = out.when(F.col("_code") == code, value)
        return out

    message = F.lit(None).cast("string")
    if checks.messages:
        message = F.when(F.col("_code") == 0, checks.messages[0])
        for code, text in enumerate(checks.messages[1:], 1):
            message = message.when(F.col("_code") == code, text)
    issues = hits.select(
        F.col("_record_id").alias("record_id"),
        *[meaning(n).alias(c) for n, c in enumerate(("rule", "kind", "category", "severity", "field"))],
        message.alias("message"),
        *([text_of(0).alias("actual"), text_of(1).alias("expected")] if values else []),
    )
    if mode == "keyword":
        from .issues import by_keyword

        return by_keyword(issues)
    return issues
