"""Customer lifetime value."""

from pyspark.sql import functions as F

from policylens.functions.rounding import round_half_even

# Months of expected life, yearly discount rate, least remaining years.
EXPECTED_LIFE_MONTHS = 60
DISCOUNT_RATE = 0.08
MIN_YEARS = 1.0


def lifetime_value(premium, tenure_months):
    """Premiums over the expected remaining years, discounted; 2 decimals."""
    months_left = F.lit(EXPECTED_LIFE_MONTHS) - tenure_months
    years = F.when(tenure_months.isNotNull(), F.greatest(F.lit(MIN_YEARS), months_left / 12.0))
    annuity = (1.0 - F.pow(F.lit(1.0 + DISCOUNT_RATE), -years)) / DISCOUNT_RATE
    return round_half_even(premium * annuity, 2)
