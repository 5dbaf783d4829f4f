"""Program text to syntax trees."""
