from quire.cli import main

main()
