"""Vietnamese readings of numbers, as array columns of alternatives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits, the words of tens, hundreds and thousands, and the forms that some digits take after tens.
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
TEN, TENS, HUNDRED, THOUSAND, GAP, POINT = "mười", "mươi", "trăm", ("nghìn", "ngàn"), ("linh", "lẻ"), "phẩy"
ONE_AFTER_TENS, FOUR_AFTER_TENS, FIVE_AFTER_TEN = ("mốt",), ("tư", "bốn"), ("lăm", "nhăm")
NUMBER = r"\d+(?:[.,]\d+)?"
MOST = 9999


def _words(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in it once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def digit(n: Column) -> Column:
    return F.get(_words(*DIGITS), n.cast("int"))


def product(*lists: Column) -> Column:
    """Every choice of one word from each list, in order, joined by a space."""
    pairs = lambda left, right: F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws(" ", a, b))))
    return reduce(pairs, lists)


def _two(n: Column) -> Column:
    def read(tens: Column, unit: Column) -> Column:
        head = F.when(tens == 1, F.lit(TEN)).otherwise(F.concat_ws(" ", digit(tens), F.lit(TENS)))
        several = tens > 1
        tail = F.when((unit == 1) & several, _words(*ONE_AFTER_TENS)).when((unit == 4) & several, _words(*FOUR_AFTER_TENS)).when(unit == 5, _words(*FIVE_AFTER_TEN)).otherwise(F.array(digit(unit)))
        return F.when(unit == 0, F.array(head)).otherwise(product(F.array(head), tail))

    return let(F.floor(n / 10), lambda tens: let(n % 10, lambda unit: read(tens, unit)))


def _below_hundred(n: Column) -> Column:
    """What follows hundreds: nothing, a gap and a digit, or tens."""
    return F.when(n == 0, _words("")).when(n < 10, product(_words(*GAP), F.array(digit(n)))).otherwise(_two(n))


def _three(n: Column) -> Column:
    head = F.array(F.concat_ws(" ", digit(F.floor(n / 100)), F.lit(HUNDRED)))
    return let(n % 100, lambda rest: product(head, _below_hundred(rest)))


def _four(n: Column) -> Column:
    head = product(F.array(digit(F.floor(n / 1000))), _words(*THOUSAND))
    no_hundred = lambda x: F.concat(product(_words(f"{DIGITS[0]} {HUNDRED}"), x), x)
    below = lambda rest: F.when(rest >= 100, _three(rest)).when(rest >= 10, let(_two(rest), no_hundred)).otherwise(_below_hundred(rest))
    return let(n % 1000, lambda rest: product(head, below(rest)))


def readings(n: Column) -> Column:
    """All readings of an integer from 0 to 9999; of others none."""
    read = lambda n: F.when(~n.between(0, MOST), F.array().cast("array<string>")).when(n < 10, F.array(digit(n))).when(n < 100, _two(n)).when(n < 1000, _three(n)).otherwise(_four(n))
    trimmed = F.transform(let(n.cast("long"), read), lambda r: F.rtrim(r))
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def digit_by_digit(s: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: digit(c)), " ")


def alternatives(s: Column) -> Column:
    """Readings of a number as written, sorted: an integer as such and digit by digit, as it stands above 9999; a decimal on both sides of its point.

    A point may be followed by up to four digits that are read as a number; more are read one by one.
    """
    short = lambda x: readings(F.when(F.length(F.ltrim(x, F.lit("0"))) <= 4, x.cast("long")).otherwise(-1))
    both = lambda x, read: F.when(F.size(read) > 0, F.array_union(read, F.array(digit_by_digit(x))))

    def written(parts: Column) -> Column:
        whole, rest = parts[0], F.get(parts, F.lit(1))
        point = lambda left, right: product(F.when(F.size(left) > 0, left).otherwise(F.array(whole)), _words(POINT), F.array_union(right, F.array(digit_by_digit(rest))))
        return let(short(whole), lambda left: F.when(F.size(parts) > 1, let(short(rest), lambda right: point(left, right))).otherwise(F.coalesce(both(whole, left), F.array(whole))))

    return F.array_sort(F.array_distinct(let(F.split(s, "[.,]"), written)))


def answer_readings(text: Column) -> Column:
    """Every way to read the numbers of a short text, in order; none without a number. The ways multiply with each number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), alternatives)
    joined = F.aggregate(found, F.array(F.lit("")), lambda acc, some: F.flatten(F.transform(acc, lambda a: F.transform(some, lambda b: F.concat(a, F.lit(" "), b)))))
    return F.when(F.size(found) > 0, F.transform(joined, lambda x: F.substring(x, 2, 1_000_000))).otherwise(F.array().cast("array<string>"))
