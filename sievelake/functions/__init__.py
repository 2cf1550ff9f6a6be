"""Column functions of the review domain: severities, text, retry schedules, strict JSON, title similarity."""
