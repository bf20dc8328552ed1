"""Where signals come from, and where reports go."""
