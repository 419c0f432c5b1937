"""Color contrast as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import GRADE_COLORS, SEVERITY_COLORS


def normal_hex(text: Column) -> Column:
    """Six upper-case hex digits, or null."""
    return F.upper(F.nullif(F.regexp_extract(F.trim(text), "^#?([0-9a-fA-F]{6})$", 1), F.lit("")))


def argb_hex(text: Column) -> Column:
    return normal_hex(F.when(F.length(text) == 8, F.substring(text, 3, 6)).otherwise(text))


def luminance(hex6: Column) -> Column:
    def channel(at: int) -> Column:
        s = F.conv(F.substring(hex6, at, 2), 16, 10).cast("int") / F.lit(255.0)
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast(fore: Column, back: Column) -> Column:
    a, b = luminance(fore), luminance(back)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def large_text(points: Column, bold: Column) -> Column:
    return (points >= 18) | (bold & (points >= 14))


def contrast_passes(ratio: Column, points: Column, bold: Column) -> Column:
    return ratio >= F.when(large_text(points, bold), 3.0).otherwise(4.5)


def undecided(ratio: Column, points: Column) -> Column:
    """Whether text of unknown size may pass or fail: enough for large text only."""
    return points.isNull() & (ratio >= 3.0) & (ratio < 4.5)


def background(run: Column, paragraph: Column, cell: Column, table: Column, page: Column, styled: Column) -> Column:
    """The ground a text stands on: the nearest color that is set, white where
    none is; unknown (null) where only a style could say."""
    near = F.coalesce(*(normal_hex(x) for x in (run, paragraph, cell, table)))
    return F.when(near.isNotNull(), near).when(~F.coalesce(styled, F.lit(False)), F.coalesce(normal_hex(page), F.lit("FFFFFF")))


def theme_color(name: Column, theme: Column) -> Column:
    """A theme's color (map of names to hex digits) by name or alias."""
    alias = F.when(name.isin("tx1", "text1"), "dk1").when(name.isin("bg1", "background1"), "lt1").when(name.isin("tx2", "text2"), "dk2").when(name.isin("bg2", "background2"), "lt2").otherwise(name)
    return normal_hex(F.coalesce(F.try_element_at(theme, name), F.try_element_at(theme, alias)))


def with_alpha(color: Column, percent: Column) -> Column:
    """A color at partial opacity; what isn't a color of six digits stays."""
    alpha = F.lower(F.lpad(F.hex(F.floor(F.greatest(F.lit(0), F.least(F.lit(100), percent)) / 100 * 255 + 0.5)), 2, "0"))
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), F.concat(color, alpha)).otherwise(color)


def _by_scheme(value: Column, colors: dict[str, tuple[str, str]], unknown: str, light: Column) -> Column:
    out = F.when(F.coalesce(value, F.lit("")) == "", unknown)
    for name, (dark, bright) in colors.items():
        out = out.when(value == name, F.when(light, bright).otherwise(dark))
    return out.otherwise(unknown)


def grade_color(grade: Column, light: Column) -> Column:
    return _by_scheme(grade, GRADE_COLORS, "#666", light)


def severity_color(severity: Column, light: Column) -> Column:
    return _by_scheme(severity, SEVERITY_COLORS, "#999", light)
