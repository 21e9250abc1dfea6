"""Plans that chain operators end to end."""
