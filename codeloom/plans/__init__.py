"""Registered queries: DataFrame form and, where SQL can say the same, the SQL to compare it with."""

MODULES = ["codeloom.plans.orphans", "codeloom.plans.pages", "codeloom.plans.catalog"]
