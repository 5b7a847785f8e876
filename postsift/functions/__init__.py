"""Column -> Column functions: text hygiene, keys, dates, money, markup."""
