"""Plans that span several jobs."""
