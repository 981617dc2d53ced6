from plinth.cli import main

main().show(100, truncate=100)
