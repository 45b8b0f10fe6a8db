"""Set-oriented operators: matching, fusion, rules, survivors."""
