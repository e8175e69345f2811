"""Operations on training data: counting, deduplicating, cleaning, scoring, formatting and encoding documents."""
